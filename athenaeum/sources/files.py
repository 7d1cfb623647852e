"""File sources and sinks: reference-manager JSON, BibTeX, notes, outlines, pages, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is read of a reference manager's export.
EXPORT = "items array<struct<itemType:string,citationKey:string,DOI:string,title:string,date:string,abstractNote:string,creators:array<struct<creatorType:string,lastName:string,firstName:string>>,attachments:array<struct<path:string>>,tags:array<struct<tag:string>>>>"


def reference_export(spark: SparkSession, path: str) -> DataFrame:
    """Items with a key that are works: key, title, authors, year, doi, pdf, keywords. A malformed document is an error."""
    return export_items(spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path))


def export_items(documents: DataFrame) -> DataFrame:
    i = documents.select(F.explode("items").alias("i")).select("i.*").filter(~F.coalesce("itemType", F.lit("")).isin("attachment", "note") & (F.coalesce("citationKey", F.lit("")) != ""))
    authors = F.transform(F.filter("creators", lambda c: c["creatorType"] == "author"), lambda c: F.concat_ws(", ", c["lastName"], c["firstName"]))
    pdfs = F.filter(F.transform("attachments", lambda a: a["path"]), lambda p: F.lower(p).endswith(".pdf"))
    return i.select(
        F.col("citationKey").alias("key"), F.trim("title").alias("title"), F.array_join(authors, "; ").alias("authors"),
        F.regexp_extract("date", r"\d{4}", 0).try_cast("int").alias("year"), F.lower("DOI").alias("doi"), F.get(pdfs, F.lit(0)).alias("pdf"), F.array_join(F.transform("tags", lambda t: t["tag"]), ", ").alias("keywords"),
    )


def uploads(rows: DataFrame, column: str = "data") -> DataFrame:
    """The same from a column of JSON texts."""
    return export_items(rows.select(F.from_json(column, EXPORT, {"mode": "FAILFAST"}).alias("d")).select("d.*"))


def upload_entries(rows: DataFrame, column: str = "data") -> DataFrame:
    """What matching needs of uploaded exports: citekey, doi, title, first author's last name, year. A malformed document is an error, a malformed item is left out."""
    i = rows.select(F.from_json(column, EXPORT, {"mode": "FAILFAST"}).alias("d")).select(F.explode("d.items").alias("i")).select("i.*")
    kept = i.filter(~F.coalesce("itemType", F.lit("")).isin("attachment", "note") & (F.coalesce("citationKey", F.lit("")) != ""))
    named = F.filter("creators", lambda c: (c["creatorType"] == "author") & (F.trim(F.coalesce(c["lastName"], F.lit(""))) != ""))
    doi = F.regexp_replace(F.regexp_replace(F.lower(F.trim("DOI")), r"^https?://(?:dx\.)?doi\.org/", ""), "^/+", "")
    return kept.select(
        F.col("citationKey").alias("citekey"), F.nullif(doi, F.lit("")).alias("doi"), F.coalesce(F.trim("title"), F.lit("")).alias("title"),
        F.coalesce(F.trim(F.get(named, F.lit(0))["lastName"]), F.lit("")).alias("first_author"), F.regexp_extract("date", r"\b(\d{4})\b", 1).try_cast("int").alias("year"),
    )


#: What is read of a batch of works to acquire; numbers and texts are both taken for ``volume`` and ``issue``.
BATCH = "array<struct<url:string,title:string,authors:string,year:int,journal:string,volume:string,issue:string,pages:string,doi:string,sections:array<string>>>"


def acquisition_batch(rows: DataFrame, column: str = "data", *keys: str) -> DataFrame:
    """Items of JSON arrays of works to acquire; texts left out are empty, the year null, the sections none."""
    i = rows.select(*keys, F.explode(F.from_json(column, BATCH, {"mode": "FAILFAST"})).alias("i")).select(*keys, "i.*")
    texts = ("url", "title", "authors", "journal", "volume", "issue", "pages", "doi")
    return i.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"sections": F.coalesce("sections", F.array().cast("array<string>"))})


def citekey_list(rows: DataFrame, column: str = "data") -> DataFrame:
    """The distinct keys of JSON lists; blanks are left out."""
    keys = rows.select(F.explode(F.from_json(column, "array<string>", {"mode": "FAILFAST"})).alias("citekey"))
    return keys.select(F.trim("citekey").alias("citekey")).filter("citekey <> ''").distinct()


GOLD = "citekey string, frame_pages array<int>, claims array<struct<quote:string,label:string>>"


def gold_documents(rows: DataFrame, name: str, column: str) -> DataFrame:
    """citekey, first_page, last_page and claims of gold documents; one without a frame or with an empty quotation is an error that names it."""
    d = rows.select(F.col(name).alias("name"), F.from_json(column, GOLD, {"mode": "FAILFAST"}).alias("d")).select("name", "d.*")
    frame = (F.size("frame_pages") == 2) & (F.get("frame_pages", F.lit(0)) >= 1) & (F.get("frame_pages", F.lit(1)) >= F.get("frame_pages", F.lit(0)))
    quoted = (F.size("claims") > 0) & F.forall("claims", lambda c: F.trim(F.coalesce(c["quote"], F.lit(""))) != "")
    checked = F.when(~F.coalesce(frame, F.lit(False)), F.raise_error(F.concat("name", F.lit(": frame_pages must be [first, last] with 1 <= first <= last"))))
    checked = checked.when(~F.coalesce(quoted, F.lit(False)), F.raise_error(F.concat("name", F.lit(": there must be claims, each with a quotation"))))
    named = checked.otherwise(F.coalesce("citekey", "name"))
    return d.select(named.alias("citekey"), F.get("frame_pages", F.lit(0)).alias("first_page"), F.get("frame_pages", F.lit(1)).alias("last_page"), "claims")


def bibtex(texts: DataFrame, column: str = "value") -> DataFrame:
    """Entries of BibTeX texts: type, key, and fields as a map; an entry ends where the next begins. One brace level nests."""
    entries = texts.select(F.explode(F.split(column, r"(?m)^(?=\s*@\w+\s*\{)")).alias("e")).filter(F.col("e").rlike(r"^\s*@\w+\s*\{"))
    value = r'(?:\{((?:[^{}]++|\{[^{}]*+\})*+)\}|"([^"]*+)")'
    names = F.regexp_extract_all("e", F.lit(rf"(\w+)\s*=\s*{value}"), F.lit(1))
    braced, quoted = (F.regexp_extract_all("e", F.lit(rf"(\w+)\s*=\s*{value}"), F.lit(i)) for i in (2, 3))
    values = F.zip_with(braced, quoted, lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b))
    fields = F.map_from_entries(F.array_distinct(F.zip_with(F.transform(names, lambda n: F.lower(n)), values, lambda k, v: F.struct(k, v))))
    return entries.select(F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("type"), F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1).alias("key"), fields.alias("fields"))


def note_parts(rows: DataFrame, column: str = "value") -> DataFrame:
    """``rows`` with front matter as a map of texts, tags and body in place of a Markdown note's text. Repeated names keep the last value;
    tags may stand in one line or as a list below their name."""
    value = F.regexp_replace(column, "\r\n", "\n")
    head = F.regexp_extract(value, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(head, "\n"), lambda s: F.struct(F.regexp_extract(s, r"^([\w-]+):", 1).alias("k"), F.trim(F.regexp_extract(s, r"^[\w-]+:\s*(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    line, below = F.regexp_extract(head, r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?", 1), F.regexp_extract(head, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|\z))+)", 1)
    listed = F.transform(F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1)), lambda x: F.trim(x))
    tags = F.filter(F.transform(F.when(F.trim(line) != "", F.split(line, ",")).otherwise(listed), lambda x: F.trim(F.regexp_replace(x, r"[\"']", ""))), lambda x: x != "")
    body = F.regexp_replace(value, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    return rows.select(*[c for c in rows.columns if c != column], F.map_from_entries(last).alias("front"), tags.alias("tags"), body.alias("body"))


def notes(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Markdown notes under a folder: path, front matter as a map of texts, tags, body."""
    return note_parts(spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.input_file_name().alias("path"), "value"))


def find_notes(found: DataFrame, words: str, most: int | None = None) -> DataFrame:
    """Notes whose body or any front matter holds ``words``, whatever their case; the first ``most`` by path if given."""
    hay = F.lower(F.concat_ws("\n", "body", F.array_join(F.map_values("front"), "\n")))
    hits = found.filter(F.contains(hay, F.lower(F.lit(words))))
    return hits.orderBy("path").limit(most) if most else hits


def write_texts(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder ``name=...`` with a file for each row's text; rows of one name share a folder."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\0").text(path)


def page_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Pages of text files, which form feeds part (as converters of page formats write them): path, page from 1, tidied text. Files are read as bytes,
    what isn't UTF-8 is replaced; a file without form feeds is one page, an empty file none."""
    from athenaeum.functions.text import tidy_page

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\0\\z", "")
    pages = whole.select("path", F.posexplode(F.split(F.regexp_replace(text, "\f\\z", ""), "\f")).alias("page", "text"))
    return pages.select("path", (F.col("page") + 1).alias("page"), F.regexp_replace(tidy_page(F.col("text")), r"^\s+|\s+$", "").alias("text"))


def marked_text(pages: DataFrame, most: int | None = None) -> DataFrame:
    """path and its pages as one text with a ``[Page N]`` before each, cut to ``most`` characters. A file's pages are one row, as they were in the file."""
    told = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"]))
    text = F.array_join(told, "\n\n")
    return pages.groupBy("path").agg((F.substring(text, 1, most) if most else text).alias("text"))


def pages_of(text: Column) -> Column:
    """Pages of a text with ``<!-- Page N -->`` markers: array of (page, start, end) in the text without them."""
    parts = F.split(text, r"\n<!-- Page (?=\d+ -->\n)")
    split = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+) -->\n", 1).alias("page"), F.regexp_replace(p, r"^\d+ -->\n", "").alias("body")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,start:int,end:int>>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p["body"])
        span = F.struct(p["page"].try_cast("int").alias("page"), acc["at"].alias("start"), (acc["at"] + n).alias("end"))
        return F.struct((acc["at"] + n + 1).alias("at"), F.when(p["page"] != "", F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(split, zero, add, lambda a: a["out"])


def outline(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Numbered headings of plan texts: key, place, id, level, title and the chapter in force there."""
    from pyspark.sql import Window

    lines = rows.select(key, F.posexplode(F.split(column, "\n")).alias("place", "line"))
    found = lines.withColumn("id", F.nullif(F.regexp_extract("line", r"^\s*(\d+(?:\.\d+)*)[.)]?\s+\S", 1), F.lit(""))).filter(F.col("id").isNotNull() & (F.length("line") < 200))
    level = F.size(F.split("id", r"\."))
    w = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return found.select(key, "place", "id", level.alias("level"), F.trim(F.regexp_replace("line", r"^\s*\d+(?:\.\d+)*[.)]?\s+", "")).alias("title"), F.last(F.when(level == 1, F.col("id")), ignorenulls=True).over(w).alias("chapter"))


def to_bibtex(works: DataFrame) -> DataFrame:
    """One ``value`` text for each work (key, type, title, authors, year), ready for a text sink."""
    field = lambda name, c: F.coalesce(F.concat(F.lit(f"  {name} = {{"), F.regexp_replace(F.col(c).cast("string"), "[{}]", ""), F.lit("},\n")), F.lit(""))
    return works.select(F.concat(F.lit("@"), F.coalesce("type", F.lit("misc")), F.lit("{"), "key", F.lit(",\n"), field("title", "title"), field("author", "authors"), field("year", "year"), F.lit("}\n")).alias("value"))


def write_swapped(df: DataFrame, root: str, version: str) -> str:
    """Writes a table's next state beside the last and points to it: readers see the old state or the new, never a part."""
    spark = df.sparkSession
    path = f"{root}/v={version}"
    df.write.mode("overwrite").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    mine = jvm.org.apache.hadoop.fs.Path(f"{root}/current.{version}")
    fs = pointer.getFileSystem(conf)
    out = fs.create(mine, True)
    out.write(bytearray(version.encode()))
    out.close()
    # one rename over the old pointer: there is no moment without one
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), conf).rename(mine, pointer, options)
    return path


def export_dataset(fragments: DataFrame, gaps: DataFrame, path: str) -> None:
    """An evaluation set as JSON lines: the first 50 labelled fragments (id, text, score of 0 to 100, label) and 20 of the first 50 gaps
    (ref_title, section, relevance), each with what an annotator fills in. Bounded, so one file each."""
    relevance = F.least(F.lit(5), F.greatest(F.lit(1), F.bround(F.col("score") / 10.0, 0).cast("int") + 1))
    labelled = fragments.filter("label IS NOT NULL").orderBy("id").limit(50).select("id", "text", F.col("label").alias("ground_truth"), relevance.alias("relevance"))
    wanted = gaps.orderBy("ref_title", "section").limit(50).orderBy(F.desc("relevance"), "ref_title", "section").limit(20)
    for name, rows in (("fragments", labelled), ("gaps", wanted)):
        rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The fragments and gaps of an exported set; a malformed line is an error."""
    read = lambda name, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}")
    return read("fragments", "id long, text string, ground_truth string, relevance int"), read("gaps", "ref_title string, section string, relevance int")


def write_bibtex(works: DataFrame, path: str) -> None:
    """Works as BibTeX texts in order of their keys, in as many files as Spark makes of the sort."""
    to_bibtex(works.orderBy("key")).write.mode("overwrite").text(path)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a folder of BibTeX files, each file read whole."""
    return bibtex(spark.read.text(path, wholetext=True))


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/current").first()[0]
    return spark.read.parquet(f"{root}/v={version}")
