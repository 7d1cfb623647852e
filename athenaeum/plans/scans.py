"""Scan plans: pages, exports, outlines built from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.functions import arrow, text
from athenaeum.plans.registry import query
from athenaeum.sources import files
from athenaeum.sources.tables import Tables


def _export(t: Tables) -> DataFrame:
    """Works as reference-manager documents, a collection each."""
    creator = F.struct(F.when(F.col("work_id") % 7 == 0, "editor").otherwise("author").alias("creatorType"), F.split_part("authors", F.lit(","), F.lit(1)).alias("lastName"), F.lit("A.").alias("firstName"))
    item = F.struct(
        F.when(F.col("work_id") % 10 == 9, "note").otherwise("book").alias("itemType"), F.when(F.col("work_id") % 13 != 0, F.concat(F.lit("k"), F.col("work_id").cast("string"))).alias("citationKey"),
        F.col("doi").alias("DOI"), "title", F.concat(F.lit("May "), F.col("year").cast("string")).alias("date"), F.array(creator).alias("creators"), F.array(F.struct(F.lit("a.PDF").alias("path"))).alias("attachments"), F.array(F.struct(F.col("lang").alias("tag"))).alias("tags"),
    )
    return t.works.groupBy("collection", (F.col("work_id") % 50).alias("part")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("data"))


@query("""SELECT 'k' || work_id AS key, trim(title) AS title, CASE WHEN work_id % 7 = 0 THEN '' ELSE split_part(authors, ',', 1) || ', A.' END AS authors, year, lower(doi) AS doi, 'a.PDF' AS pdf, lang AS keywords FROM works WHERE work_id % 10 <> 9 AND work_id % 13 <> 0""")
def a2_reference_export(t: Tables) -> DataFrame:
    return files.uploads(_export(t))


@query("""SELECT 'k' || work_id AS citekey, lower(doi) AS doi, trim(title) AS title, CASE WHEN work_id % 7 = 0 THEN '' ELSE split_part(authors, ',', 1) END AS first_author, year FROM works WHERE work_id % 10 <> 9 AND work_id % 13 <> 0""")
def a3_uploaded_entries(t: Tables) -> DataFrame:
    """What matching needs of uploaded exports."""
    return files.upload_entries(_export(t))


@query("SELECT lang, 'https://x.org/' || work_id AS url, title, authors, year, '' AS journal, '12' AS volume, '' AS issue, '' AS pages, coalesce(doi, '') AS doi, CASE WHEN work_id % 2 = 0 THEN section ELSE '' END AS sections FROM works")
def a9_acquisition_batch(t: Tables) -> DataFrame:
    """Batches of works to acquire: what an item leaves out has its default."""
    item = F.struct(
        F.concat(F.lit("https://x.org/"), F.col("work_id").cast("string")).alias("url"), "title", "authors", "year", F.lit(12).alias("volume"), "doi",
        F.when(F.col("work_id") % 2 == 0, F.array("section")).alias("sections"),
    )
    batches = t.works.groupBy("lang", (F.col("work_id") % 50).alias("part")).agg(F.to_json(F.collect_list(item)).alias("data"))
    return files.acquisition_batch(batches, "data", "lang").withColumn("sections", F.array_join("sections", ","))


@query("SELECT DISTINCT 'k' || work_id AS citekey FROM works WHERE title <> ''")
def a9_citekey_list(t: Tables) -> DataFrame:
    lists = t.works.filter("title <> ''").groupBy((F.col("work_id") % 50).alias("part")).agg(F.to_json(F.collect_list(F.concat(F.lit("k"), F.col("work_id").cast("string")))).alias("data"))
    return files.citekey_list(lists, "data")


@query("SELECT CASE WHEN chapter % 2 = 0 THEN 'g' || chapter ELSE 'file' || chapter END AS citekey, chapter AS first_page, chapter + 2 AS last_page, count(*) AS claims FROM works WHERE title <> '' GROUP BY chapter")
def a9_gold_documents(t: Tables) -> DataFrame:
    """Gold documents: the frame of pages and the claims in it, checked when read."""
    c = F.col("chapter").cast("string")
    docs = t.works.filter("title <> ''").groupBy("chapter").agg(F.collect_list(F.struct(F.col("title").alias("quote"))).alias("claims"))
    made = docs.select(F.concat(F.lit("file"), c).alias("name"), F.to_json(F.struct(F.when(F.col("chapter") % 2 == 0, F.concat(F.lit("g"), c)).alias("citekey"), F.array("chapter", F.col("chapter") + 2).alias("frame_pages"), "claims")).alias("data"))
    return files.gold_documents(made, "name", "data").select("citekey", "first_page", "last_page", F.size("claims").cast("long").alias("claims"))


@query(r"SELECT work_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '-' || chr(10), '', 'g'), '(?m)^[ \t]*[0-9]+[ \t]*\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS n FROM works")
def a4_tidy_pages(t: Tables) -> DataFrame:
    return t.works.select("work_id", F.length(text.tidy_page(F.col("text"))).cast("long").alias("n"))


_BLOCK = r"(?i)</?(?:p|div|br|li|tr|td|th|h[1-6]|blockquote|article|section|header|footer|nav|aside|figure|figcaption)(?:\s[^>]*)?/?>"
_SHOWN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<head[ >].*?</head\s*>|<script.*?</script\s*>|<style.*?</style\s*>', '', 'g'), '{_BLOCK}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
_PLAIN = "replace(replace(replace(replace(replace(replace(" + _SHOWN + ", '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t\r\f\v]*\n[ \t\r\f\v]*', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages")
def a5_visible_text(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", arrow.visible_text_udf("html").alias("text"))


#: What hides more than it should from a reader of tags alone; none of it shows.
_ODD = """<script>for(var i=0;i<n;i++){if(a<b)document.write("<p>no</p>")}</script><style>a>b{content:"</p>"}</style><!-- <p>no</p> > --><a title="1 > 0" rel='<p>no</p>'></a><script><!-- <script>no</script> <b>no --></script><meta name=x><link rel=y href=z>"""


@query(rf"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '[ \t\r\f\v]*\n[ \t\r\f\v]*', chr(10), 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS shown FROM pages")
def a5_odd_markup(t: Tables) -> DataFrame:
    """Pages with scripts, styles, comments and quoted marks put into their bodies show what they showed without."""
    odd = F.regexp_replace("html", r"(?i)(<body[^>]*>)", "$1" + _ODD.replace("\\", "\\\\").replace("$", "\\$"))
    return t.raw("pages").select("page_id", F.md5(arrow.visible_text_udf(odd)).alias("shown"))


@query(r"""WITH p AS (SELECT work_id, length(title) AS a, length(lang) AS b FROM works) SELECT work_id, unnest([1, 2]) AS page, unnest([5, 6 + a]) AS start, unnest([5 + a, 6 + a + b]) AS "end" FROM p""")
def a6_page_spans(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("head\n<!-- Page 1 -->\n"), "title", F.lit("\n<!-- Page 2 -->\n"), "lang")
    spans = t.works.select("work_id", F.explode(files.pages_of(marked)).alias("s")).select("work_id", "s.*")
    return spans.withColumns({c: F.col(c).cast("long") for c in ("start", "end")})


@query("SELECT 'online' AS type, 'k' || work_id AS key, regexp_replace(title, '[{}]', '', 'g') AS title, CAST(year AS VARCHAR) AS year FROM works WHERE title <> ''")
def a8_bibtex(t: Tables) -> DataFrame:
    works = t.works.filter("title <> ''").select(F.concat(F.lit("k"), F.col("work_id").cast("string")).alias("key"), F.lit("online").alias("type"), "title", "authors", "year")
    parsed = files.bibtex(files.to_bibtex(works))
    return parsed.select("type", "key", F.try_element_at("fields", F.lit("title")).alias("title"), F.try_element_at("fields", F.lit("year")).alias("year"))


@query("SELECT chapter AS plan, CAST(unnest([0, 1, 2]) AS INTEGER) AS place, unnest([CAST(chapter AS VARCHAR), chapter || '.1', chapter || '.1.2']) AS id, CAST(unnest([1, 2, 3]) AS INTEGER) AS level, unnest(['Chapter', 'Part', 'Item']) AS title, CAST(chapter AS VARCHAR) AS top FROM (SELECT DISTINCT chapter FROM works)")
def a10_outline(t: Tables) -> DataFrame:
    c = F.col("chapter").cast("string")
    plans = t.works.select("chapter").distinct().select(F.col("chapter").alias("plan"), F.concat(c, F.lit(". Chapter\n"), c, F.lit(".1 Part\n"), c, F.lit(".1.2 Item\nloose line")).alias("text"))
    return files.outline(plans, "plan", "text").withColumnRenamed("chapter", "top")


@query("SELECT w.work_id, coalesce(a.title, w.title) AS title, CASE WHEN a.cited IS NOT NULL THEN 'first' ELSE 'own' END AS source FROM works w LEFT JOIN cited a ON a.cited = w.work_id AND length(a.title) > 9")
def a11_lookup_chain(t: Tables) -> DataFrame:
    """Staged lookups in order of trust: the first that answers gives the value."""
    a = t.cited.filter(F.length("title") > 9).select(F.col("cited").alias("work_id"), F.col("title").alias("t1"))
    return t.works.join(a, "work_id", "left").select("work_id", F.coalesce("t1", "title").alias("title"), F.when(F.col("t1").isNotNull(), "first").otherwise("own").alias("source"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2))"
_ALIKE = "(coalesce(len(list_intersect(a.ws, {0}.ws)) > 0.6::DOUBLE * greatest(len(a.ws), len({0}.ws)), false))"


@query(f"""WITH a AS (SELECT work_id, title, doi, {_WORDS.format("title")} AS ws FROM works WHERE title <> ''),
 x AS (SELECT doi, min(title) AS title FROM (SELECT doi, title || ' added' AS title FROM works WHERE doi IS NOT NULL AND work_id % 2 = 0 AND title <> '') GROUP BY doi),
 y AS (SELECT work_id, CASE WHEN work_id % 5 = 0 THEN 'something else' ELSE lower(title) END AS title FROM works WHERE work_id % 3 > 0 AND title <> ''), z AS (SELECT work_id, title FROM works WHERE work_id % 7 > 0 AND title <> ''),
 x2 AS (SELECT *, {_WORDS.format("title")} AS ws FROM x), y2 AS (SELECT *, {_WORDS.format("title")} AS ws FROM y), z2 AS (SELECT *, {_WORDS.format("title")} AS ws FROM z)
 SELECT a.work_id, CASE WHEN {_ALIKE.format("x2")} THEN 'first' WHEN {_ALIKE.format("y2")} THEN 'second' WHEN {_ALIKE.format("z2")} THEN 'third' END AS source,
  CASE WHEN {_ALIKE.format("x2")} THEN x2.title WHEN {_ALIKE.format("y2")} THEN y2.title WHEN {_ALIKE.format("z2")} THEN z2.title END AS found FROM a LEFT JOIN x2 ON x2.doi = a.doi LEFT JOIN y2 ON y2.work_id = a.work_id LEFT JOIN z2 ON z2.work_id = a.work_id""")
def a11_accepted_lookups(t: Tables) -> DataFrame:
    """Three staged lookups in order of trust; an answer counts if its title is the one asked for."""
    from athenaeum.operators.matching import first_accepted

    w = t.works.filter("title <> ''").select("work_id", "title", "doi")
    by_doi = w.filter("doi IS NOT NULL AND work_id % 2 = 0").select("doi", F.concat("title", F.lit(" added")).alias("title"))
    by_id = w.filter("work_id % 3 > 0").select("work_id", F.when(F.col("work_id") % 5 == 0, "something else").otherwise(F.lower("title")).alias("title"))
    last = w.filter("work_id % 7 > 0").select("work_id", "title")
    found = first_accepted(w.withColumnRenamed("title", "asked"), "asked", [("first", by_doi, "doi"), ("second", by_id, "work_id"), ("third", last, "work_id")], ["title"])
    return found.select("work_id", "source", F.col("title").alias("found"))


@query("""WITH f AS (SELECT fragment_id, 'fragment' AS kind, text AS said, intent AS detail, least(5, greatest(1, CAST(round_even(relevance * 20 / 10.0, 0) AS INTEGER) + 1)) AS relevance FROM fragments WHERE intent IS NOT NULL ORDER BY fragment_id, text LIMIT 50),
 g AS (SELECT * FROM (SELECT title, authors, CAST(year % 6 AS INTEGER) AS relevance FROM cited ORDER BY title, authors LIMIT 50) ORDER BY relevance DESC, title, authors LIMIT 20)
 SELECT kind, CAST(fragment_id AS VARCHAR) AS id, said, detail, relevance FROM f UNION ALL SELECT 'gap', '', title, authors, relevance FROM g""")
def b13_written_dataset(t: Tables) -> DataFrame:
    """An evaluation set written as JSON lines and read back."""
    from athenaeum.operators.shared import fresh_path

    path = fresh_path(t.spark, "dataset")
    labelled = t.fragments.select(F.col("fragment_id").alias("id"), "text", (F.col("relevance") * 20).alias("score"), F.col("intent").alias("label"))
    files.export_dataset(labelled, t.cited.select(F.col("title").alias("ref_title"), F.col("authors").alias("section"), (F.col("year") % 6).cast("int").alias("relevance")), path)
    fragments, gaps = files.read_dataset(t.spark, path)
    one = fragments.select(F.lit("fragment").alias("kind"), F.col("id").cast("string").alias("id"), F.col("text").alias("said"), F.col("ground_truth").alias("detail"), "relevance")
    return one.union(gaps.select(F.lit("gap"), F.lit(""), "ref_title", "section", "relevance"))


@query("SELECT 'k' || work_id AS key, 'online' AS type, regexp_replace(title, '[{}]', '', 'g') AS title, CAST(year AS VARCHAR) AS year, authors FROM works WHERE title <> ''")
def b13_written_bibliography(t: Tables) -> DataFrame:
    """All works written as BibTeX files in order of their keys, and scanned again."""
    from athenaeum.operators.shared import fresh_path

    path = fresh_path(t.spark, "bibliography")
    files.write_bibtex(t.works.filter("title <> ''").select(F.concat(F.lit("k"), F.col("work_id").cast("string")).alias("key"), F.lit("online").alias("type"), "title", "authors", "year"), path)
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return files.read_bibtex(t.spark, path).select("key", "type", field("title").alias("title"), field("year").alias("year"), field("author").alias("authors"))


@query("""WITH f AS (SELECT 'http/' || p_name || ' ' || p_partkey || '.pdf' AS path, p_partkey FROM part), c AS (SELECT x.cited, f.path, CASE WHEN f.p_partkey = x.cited THEN 1 ELSE 2 END AS tier FROM cited x JOIN f ON f.p_partkey = x.cited OR f.p_partkey = x.cited + 1)
 SELECT cited, path FROM (SELECT *, row_number() OVER (PARTITION BY cited ORDER BY tier, path) AS n FROM c) WHERE n = 1""")
def a13_path_resolution(t: Tables) -> DataFrame:
    from athenaeum.operators.matching import cascade

    f = t.raw("part").select(F.concat(F.lit("http/"), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), F.col("p_partkey").alias("cited"))
    return cascade("cited", [f.select("cited", "path"), f.select((F.col("cited") - 1).alias("cited"), "path").join(t.cited.select("cited"), "cited", "left_semi")], ["path"]).select("cited", "path")


#: Works with keys, and files named in five ways, a seventh of the works each.
_SURNAME = "'author' || translate(CAST(p_partkey % 97 AS VARCHAR), '0123456789', 'abcdefghij')"
_FILED = f"""k AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS one, split_part(p_name, ' ', 2) AS two, CAST(1975 + p_size AS VARCHAR) AS year, {_SURNAME} AS surname FROM part),
 w AS (SELECT id, surname || upper(one[1]) || one[2:] || year AS key, one || ' of ' || two || ' and the other ' || two AS title, CASE WHEN id % 7 = 0 THEN 'store/direct/' || id || '.pdf' WHEN id % 7 = 6 THEN 'gone/' || id || '.pdf' END AS direct,
  CASE WHEN id % 7 = 1 THEN 'store/lookup/' || id || '/file.pdf' END AS lookup FROM k),
 f AS (SELECT CASE id % 7 WHEN 0 THEN 'store/direct/' || id || '.pdf' WHEN 1 THEN 'store/lookup/' || id || '/file.pdf' WHEN 2 THEN 'store/keys/x' || surname || upper(one[1]) || one[2:] || year || 'v' || id || '.pdf'
  WHEN 3 THEN 'store/titles/' || one || '-' || two || ' (' || year || ') ' || id || '.pdf' WHEN 4 THEN 'store/authors/' || surname || ' and others - ' || year || ' - ' || one || '.pdf' END AS path FROM k WHERE id % 7 < 5)"""


@query(rf"""WITH {_FILED}, n AS (SELECT DISTINCT path, lower(regexp_extract(path, '[^/]+$')) AS name FROM f),
 i AS (SELECT path, name, list_concat(regexp_extract_all(name, '\p{{L}}+|\d+'), regexp_extract_all(name, '[\p{{L}}\d]+')) AS words, list_concat(regexp_extract_all(head, '\p{{L}}+|\d+'), regexp_extract_all(head, '[\p{{L}}\d]+')) AS head
   FROM (SELECT *, CASE WHEN contains(name, ' - ') THEN split_part(name, ' - ', 1) ELSE name[:40] END AS head FROM n)),
 a AS (SELECT *, regexp_extract(key, '\d{{4}}') AS year, list_distinct(list_slice(regexp_extract_all(lower(title), '[\p{{L}}\d]{{4,}}'), 1, 5)) AS wanted, list_filter(list_transform(regexp_extract_all(key, '[A-Z][a-z]+|[a-z]+|\d{{4}}'), lambda p: lower(p)), lambda p: length(p) >= 3) AS parts FROM w),
 m AS (SELECT id, 1 AS tier, path FROM a JOIN i ON path = direct UNION ALL SELECT id, 2, path FROM a JOIN i ON path = lookup UNION ALL SELECT id, 3, path FROM a JOIN i ON contains(name, lower(key))
  UNION ALL SELECT id, 4, path FROM a JOIN i ON len(wanted) >= 2 AND contains(name, year) AND len(list_intersect(wanted, words)) >= 2
  UNION ALL SELECT id, 5, path FROM a JOIN i ON len(parts) >= 3 AND list_contains(head, parts[1]) AND len(list_intersect(list_distinct(parts[2:]), words)) >= 2)
 SELECT id, tier, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, path) AS n FROM m) WHERE n = 1""")
def a13_five_tiers(t: Tables) -> DataFrame:
    """Each work's file by the best of five tiers."""
    from athenaeum.operators.paths import resolve

    i, year = F.col("p_partkey"), (1975 + F.col("p_size")).cast("string")
    one, two = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    surname = F.concat(F.lit("author"), F.translate((i % 97).cast("string"), "0123456789", "abcdefghij"))
    k = t.raw("part").select(i.alias("id"), one.alias("one"), two.alias("two"), year.alias("year"), surname.alias("surname"), F.concat(surname, F.initcap(one), year).alias("key"))
    own = lambda n, *parts: F.when(F.col("id") % 7 == n, F.concat(*[F.lit(p) if p[:1] in "/.- (v)" or "/" in p or " " in p else F.col(p) for p in parts]))
    direct, lookup = own(0, "store/direct/", "id", ".pdf"), own(1, "store/lookup/", "id", "/file.pdf")
    works = k.select("id", "key", F.concat("one", F.lit(" of "), "two", F.lit(" and the other "), "two").alias("title"), F.coalesce(direct, own(6, "gone/", "id", ".pdf")).alias("direct"), lookup.alias("lookup"))
    titles, authors = own(3, "store/titles/", "one", "-", "two", " (", "year", ") ", "id", ".pdf"), own(4, "store/authors/", "surname", " and others - ", "year", " - ", "one", ".pdf")
    path = F.coalesce(direct, lookup, own(2, "store/keys/x", "key", "v", "id", ".pdf"), titles, authors)
    return resolve(works, k.select(path.alias("path")).filter("path IS NOT NULL"))


@query(r"""WITH p AS (SELECT chapter, work_id // 1000 AS part, title, length(title) AS n, row_number() OVER (PARTITION BY chapter, work_id // 1000 ORDER BY work_id) AS page FROM works WHERE regexp_matches(title, '^[\p{L}][\p{L} ,]*[\p{L}]$'))
 SELECT chapter, part, page, title AS text, CAST(sum(n + length(CAST(page AS VARCHAR)) + 10) OVER (PARTITION BY chapter, part) - 2 AS BIGINT) AS marked FROM p""")
def a4_page_files(t: Tables) -> DataFrame:
    """Text files for each chapter and thousand of works, a title a page with its number below, written, scanned as bytes, tidied and marked."""
    from athenaeum.operators.shared import fresh_path

    path = fresh_path(t.spark, "pages")
    titled = t.works.filter(F.col("title").rlike(r"^[\p{L}][\p{L} ,]*[\p{L}]$")).select("chapter", "work_id", "title")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("work_id", "title"))), lambda w: F.concat(w["title"], F.lit("\n"), w["work_id"].cast("string"), F.lit("\n\n\n\n")))
    name = F.concat_ws("-", F.col("chapter"), F.floor(F.col("work_id") / 1000))
    files.write_texts(titled.groupBy(name.alias("name")).agg(F.array_join(pages, "\f").alias("text")), path)
    found = files.page_files(t.spark, path, "*.txt")
    marked = files.marked_text(found).select("path", F.length("text").cast("long").alias("marked"))
    of = lambda i: F.regexp_extract("path", r"name=(\d+)-(\d+)", i)
    return found.join(marked, "path").select(of(1).cast("int").alias("chapter"), of(2).cast("long").alias("part"), F.col("page").cast("long").alias("page"), "text", "marked")


@query(r"""WITH n AS (SELECT section, max(lang) AS lang, max(title) AS title, count(*) AS works FROM works WHERE NOT regexp_matches(title, '[\n\r"'':]') GROUP BY section)
 SELECT section, lang AS state, '#' || section || '|' || lang AS tags, CAST(works AS VARCHAR) AS works, title, contains(lower(title), 'ie') AS found FROM n""")
def a7_note_files(t: Tables) -> DataFrame:
    """A note for each section with front matter and tags, written as Markdown texts, scanned, taken apart and searched."""
    from athenaeum.operators.shared import fresh_path

    path, c = fresh_path(t.spark, "notes"), F.col("section")
    n = t.works.filter(~F.col("title").rlike("[\\n\\r\"':]")).groupBy("section").agg(F.max("lang").alias("lang"), F.max("title").alias("title"), F.count(F.lit(1)).alias("works"))
    tags = F.when(F.length(c) % 2 == 0, F.concat(F.lit("tags: ['#"), c, F.lit("', "), "lang", F.lit("]"))).otherwise(F.concat(F.lit("tags:\n  - \"#"), c, F.lit("\"\n  - "), "lang"))
    text = F.concat(F.lit("---\nstate: first\nworks: "), F.col("works").cast("string"), F.lit("\n"), tags, F.lit("\nstate: "), "lang", F.lit("\n---\n"), "title")
    files.write_texts(n.select(c.alias("name"), text.alias("text")), path)
    read = files.notes(t.spark, path, "*.txt")
    hits = files.find_notes(read.withColumn("front", F.create_map().cast("map<string,string>")), "IE").select("path", F.lit(True).alias("hit"))
    told = read.join(hits, "path", "left")
    return told.select(F.regexp_extract("path", r"name=([\d.]+)", 1).alias("section"), F.col("front")["state"].alias("state"), F.array_join("tags", "|").alias("tags"), F.col("front")["works"].alias("works"), F.regexp_replace("body", "\0\\z", "").alias("title"), F.coalesce("hit", F.lit(False)).alias("found"))


@query("SELECT collection, lang, count(*) AS n FROM works GROUP BY 1, 2")
def a7_tag_histogram(t: Tables) -> DataFrame:
    return t.works.select("collection", F.explode(F.array("lang")).alias("lang")).groupBy("collection", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT fragment_id, text, least(5, greatest(1, CAST(round_even(relevance / 2.0, 0) AS INTEGER) + 1)) AS relevance FROM fragments WHERE intent IS NOT NULL ORDER BY fragment_id, text LIMIT 50")
def b13_dataset_export(t: Tables) -> DataFrame:
    first = t.fragments.filter("intent is not null").orderBy("fragment_id", "text").limit(50)
    return first.select("fragment_id", "text", F.least(F.lit(5), F.greatest(F.lit(1), F.bround(F.col("relevance") / F.lit(2.0), 0).cast("int") + 1)).alias("relevance"))
