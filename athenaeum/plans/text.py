"""Text plans: scalar functions, extraction, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.functions import arrow, references, text
from athenaeum.operators import quotations
from athenaeum.plans.registry import query
from athenaeum.sources.tables import Tables


@query(r"SELECT work_id, trim(regexp_replace(regexp_replace(text, '-[\r\n]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM works")
def j1_squeeze(t: Tables) -> DataFrame:
    return t.works.select("work_id", text.squeeze(F.col("text")).alias("t"))


@query(r"SELECT work_id, trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '-[\r\n]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM works")
def j1_normalize_unicode(t: Tables) -> DataFrame:
    return t.works.select("work_id", arrow.squeeze_udf("text").alias("t"))


@query(r"SELECT work_id, length(t) AS n, md5(t) AS squeezed FROM (SELECT work_id, trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '-[\r\n]+', '', 'g'), '\s+', ' ', 'g')) AS t FROM works)")
def j2_normalize_with_places(t: Tables) -> DataFrame:
    """Every character's place is kept: as many places as characters, in order, and each word is found again at its place."""
    made = t.works.select("work_id", "text", arrow.squeeze_with_places_udf("text").alias("m"))
    ordered = F.forall(F.sequence(F.lit(1), F.size("m.places") - 1), lambda i: F.get("m.places", i) > F.get("m.places", i - 1))
    fits = (F.size("m.places") == F.length("m.text")) & ((F.size("m.places") < 2) | ordered)
    return made.select("work_id", F.length("m.text").cast("long").alias("n"), F.when(fits, F.md5("m.text")).alias("squeezed"))


_WHOLE = "SELECT d.work_id, b.item_id, instr(d.text, b.text) AS place FROM works d JOIN benchmark b ON contains(d.text, b.text)"
_FOUND = "SELECT item_id, count(d.work_id) > 0 AS confirmed, CASE WHEN count(d.work_id) > 0 THEN 'confirmed' ELSE 'downgraded' END AS status FROM benchmark b LEFT JOIN works d ON contains(d.text, b.text) GROUP BY item_id"


def _quotes(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", F.col("text").alias("q"))


@query(_WHOLE)
def j3_locate_exact(t: Tables) -> DataFrame:
    """Places of all whole quotations in all texts."""
    return quotations.exact(t.works.select("work_id", "text"), _quotes(t))


@query(_WHOLE)
def j3_locate_exact_whole(t: Tables) -> DataFrame:
    """The same under the name it had when ``j3_locate_exact`` read a part."""
    return j3_locate_exact(t)


@query()
def j3_locate_fuzzy(t: Tables) -> DataFrame:
    """The same with up to a twentieth of the characters changed, wherever they stand. A work has one row for each of its labels, which texts are not dealt to."""
    found = quotations.fuzzy(t.raw("documents").select(F.col("doc_id").alias("work_id"), "text"), _quotes(t))
    return found.join(t.raw("labels").select(F.col("doc_id").alias("work_id")), "work_id", "left").select("work_id", "item_id", "span")


@query(_FOUND)
def j4_verbatim(t: Tables) -> DataFrame:
    found = j3_locate_exact(t).select("item_id").distinct().withColumn("hit", F.lit(True))
    out = t.raw("benchmark").select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("confirmed"))
    return out.withColumn("status", F.when(F.col("confirmed"), "confirmed").otherwise("downgraded"))


@query(_FOUND)
def j4_verbatim_whole(t: Tables) -> DataFrame:
    """The same under the name it had when ``j4_verbatim`` read a part."""
    return j4_verbatim(t)


@query(r"SELECT cited, trim(regexp_replace(lower(title || ' – “X”  y'), '[‐‑‒–—―−]', '-', 'g')) AS a, substr(regexp_replace(lower(title), '[^a-zа-яё0-9]', '', 'g'), 1, 40) AS key, md5(lower(trim(title))) AS h FROM cited".replace("AS a,", "AS raw,").replace("trim(regexp_replace(lower(title || ' – “X”  y'), '[‐‑‒–—―−]', '-', 'g')) AS raw", r"trim(regexp_replace(regexp_replace(lower(title || ' – “X”  y'), '[‐‑‒–—―−]', '-', 'g'), '\s+', ' ', 'g')) AS a"))
def j5_j6_title_keys(t: Tables) -> DataFrame:
    return t.cited.select("cited", text.comparable(F.concat("title", F.lit(" – “X”  y"))).alias("a"), text.title_key(F.col("title")).alias("key"), F.md5(F.lower(F.trim("title"))).alias("h"))


@query(r"SELECT work_id, lower(regexp_replace(regexp_extract('see https://doi.org/' || doi || './', '(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9_]+)', 1), '[./]+$', '')) AS doi FROM works WHERE doi IS NOT NULL")
def j7_doi(t: Tables) -> DataFrame:
    return t.works.filter("doi is not null").select("work_id", text.doi(F.concat(F.lit("see https://doi.org/"), F.col("doi"), F.lit("./"))).alias("doi"))


_HEADS = "CASE work_id % 4 WHEN 0 THEN 'Intro' || chr(10) || 'Abstract' || chr(10) WHEN 1 THEN 'Аннотация: ' WHEN 2 THEN 'РЕЗЮМЕ.' || chr(10) ELSE 'Nothing ' END || title || CASE WHEN work_id % 3 = 0 THEN ' Keywords: a' WHEN work_id % 3 = 1 THEN chr(10) || 'more' || chr(10) || ' ' || chr(10) ELSE ' Введение' END || chr(10) || text"


@query(rf"SELECT work_id, regexp_replace(regexp_replace(regexp_extract(body, '{text.ABSTRACT.replace('(?isu)', '(?is)')}', 1), '^\s+|\s+$', '', 'g'), '\s*\n\s*', ' ', 'g') AS abstract FROM (SELECT work_id, {_HEADS} AS body FROM works)")
def j8_abstract(t: Tables) -> DataFrame:
    head = F.when(F.col("work_id") % 4 == 0, "Intro\nAbstract\n").when(F.col("work_id") % 4 == 1, "Аннотация: ").when(F.col("work_id") % 4 == 2, "РЕЗЮМЕ.\n").otherwise("Nothing ")
    tail = F.when(F.col("work_id") % 3 == 0, " Keywords: a").when(F.col("work_id") % 3 == 1, "\nmore\n \n").otherwise(" Введение")
    return t.works.select("work_id", text.abstract(F.concat(head, "title", tail, F.lit("\n"), "text")).alias("abstract"))


@query(r"""SELECT work_id, regexp_extract(ref, '\(((?:19|20)[0-9]{2})\)', 1) AS year, regexp_extract(ref, '^([^,(]+),', 1) AS surname, regexp_extract(ref, '\)\. ([^.]+)\.', 1) AS title, regexp_extract(ref, '(https?://[^ ]+)', 1) AS url
 FROM (SELECT work_id, authors || ' (' || year || '). ' || title || '. https://x.org/' || work_id || ' .' AS ref FROM works WHERE year IS NOT NULL AND title <> '')""")
def j9_reference_parts(t: Tables) -> DataFrame:
    ref = F.concat("authors", F.lit(" ("), F.col("year").cast("string"), F.lit("). "), "title", F.lit(". https://x.org/"), F.col("work_id").cast("string"), F.lit(" ."))
    part = lambda p: F.regexp_extract("ref", p, 1)
    r = t.works.filter("year is not null and title <> ''").select("work_id", ref.alias("ref"))
    return r.select("work_id", part(r"\(((?:19|20)[0-9]{2})\)").alias("year"), part("^([^,(]+),").alias("surname"), part(r"\)\. ([^.]+)\.").alias("title"), part(r"(https?://[^ ]+)").alias("url"))


_CITABLE = "c AS (SELECT work_id, split_part(authors, ',', 1) AS name, year, doi, replace(replace(replace(title, '(', ''), ')', ''), ';', '') AS title FROM works WHERE year IS NOT NULL AND regexp_matches(title, '^[\\p{L} ,]{10,}$') AND NOT regexp_matches(title, '[,\\s]$'))"


@query(rf"""WITH {_CITABLE} SELECT work_id, unnest([1, 3, 4]) AS number, unnest([lower(doi), NULL, '10.5555/x' || work_id]) AS doi, unnest([NULL, 'https://x.org/' || work_id, NULL]) AS url, year,
 unnest([name || ', A', name || ' A', name || ' A']) AS authors, title, unnest(['Journal of Things', 'Annals', 'Press']) AS journal FROM c""")
def j9_bibliographies(t: Tables) -> DataFrame:
    """Bibliographies of four numbered entries in three forms, one too short to be any: cut, parsed and named by number."""
    name, year = F.split_part("authors", F.lit(","), F.lit(1)), F.col("year").cast("string")
    c = t.works.filter(F.col("year").isNotNull() & F.col("title").rlike(r"^[\p{L} ,]{10,}$") & ~F.col("title").rlike(r"[,\s]$")).withColumns({"name": name, "y": year, "i": F.col("work_id").cast("string")})
    lines = [
        ("[1] ", "name", ", A. (", "y", "). ", "title", ". Journal of Things, 12(3), 4-5.", "doi_part"),
        ("2. short",),
        ("[3] ", "name", " A. ", "title", ". Annals. ", "y", ";1:3-4. https://x.org/", "i", "."),
        (" 4) ", "name", " A. ", "title", ".\n Press. ", "y", ". doi:10.5555/X", "i", "."),
    ]
    c = c.withColumn("doi_part", F.coalesce(F.concat(F.lit(" https://doi.org/"), "doi"), F.lit("")))
    text_of = F.concat_ws("\n", *[F.concat(*[F.col(p) if p in c.columns else F.lit(p) for p in line]) for line in lines])
    entry = c.select("work_id", F.explode(references.entries(text_of)).alias("e"))
    return entry.select("work_id", F.col("e.number").alias("number"), references.parsed(F.col("e.entry")).alias("p")).select("work_id", "number", "p.*")


@query("""SELECT work_id, form, first, blocking, words, names FROM (SELECT work_id, 'author' || (work_id % 97) AS low, unnest(['last first', 'given last', 'last initial', 'pairs']) AS form, unnest(['Author', 'Author', 'Author', 'Author']) AS first,
 unnest(['author', 'author', 'j.', 'author']) AS blocking, unnest(['author,doe', 'author,doe,mary', 'author', 'author,doe']) AS words, unnest(['Author A.|Doe B.', 'Author M.|Doe B.', 'J. A.', 'Author A.|Doe B.']) AS names FROM works)""")
def j10_author_forms(t: Tables) -> DataFrame:
    """First surname, blocking surname, set of surnames and list of names, of the forms in which sources give authors."""
    forms = {"last first": "Author, A.; Doe, B.", "given last": "Mary Author and B. Doe", "last initial": "Author J.", "pairs": "Author, A., Doe, B."}
    each = t.works.select("work_id", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.lit(v).alias("authors")) for k, v in forms.items()])).alias("f")).select("work_id", "f.*")
    who = F.col("authors")
    first = F.when(F.col("form") == "given last", references.first_surname(F.split_part(who, F.lit(" and "), F.lit(1)))).otherwise(references.first_surname(who))
    names = F.array_join(F.transform(references.author_list(who), lambda n: F.concat_ws(" ", n["last"], n["initial"])), "|")
    return each.select("work_id", "form", first.alias("first"), references.blocking_surname(who).alias("blocking"), F.array_join(references.surname_set(who), ",").alias("words"), names.alias("names"))


@query(r"""SELECT work_id, '10.1234/W' || work_id AS anywhere, CASE WHEN length(text) < 2900 THEN '10.1234/w' || work_id END AS near, CASE work_id % 3 WHEN 0 THEN '10.1234/W' || work_id ELSE '' END AS of_url, '10.1234/w' || work_id AS normal FROM works WHERE text <> '' AND NOT regexp_matches(text, '10\.[0-9]{4}')""")
def j7_doi_forms(t: Tables) -> DataFrame:
    """DOIs anywhere in a text, near its start, in a resolver's address, and normalized."""
    i = F.col("work_id").cast("string")
    found = F.concat(F.col("text"), F.lit("\nfooter 10.1234/W"), i, F.lit(". end"))
    w = t.works.filter("text <> ''").filter(~F.col("text").rlike(r"10\.[0-9]{4}"))
    host = F.when(F.col("work_id") % 3 == 0, "https://doi.org/").when(F.col("work_id") % 3 == 1, "https://x.org/").otherwise("doi.org ")
    dressed = F.when(F.col("work_id") % 2 == 0, F.concat(F.lit(" https://dx.doi.org/10.1234/W"), i, F.lit("/."))).otherwise(F.concat(F.lit("DOI: 10.1234/w"), i))
    near = F.when(F.length("text") < 2900, text.doi(found))
    return w.select("work_id", references.doi_anywhere(found).alias("anywhere"), near.alias("near"), references.doi_of_url(F.concat(host, F.lit("10.1234/W"), i)).alias("of_url"), text.normalize_doi(dressed).alias("normal"))


@query("SELECT work_id, split_part(authors, ',', 1) AS surname, split_part(authors, ',', 1) || coalesce(CAST(year AS VARCHAR), '') AS stem FROM works")
def j10_surnames(t: Tables) -> DataFrame:
    s = text.surname(F.col("authors"))
    return t.works.select("work_id", s.alias("surname"), F.concat(s, F.coalesce(F.col("year").cast("string"), F.lit(""))).alias("stem"))


@query("SELECT work_id, strip_accents(replace(replace(replace(replace(lower(title), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')) AS title FROM works")
def j11_latin(t: Tables) -> DataFrame:
    return t.works.select("work_id", arrow.latin_udf("title").alias("title"))


@query(r"""WITH k AS (SELECT cited, authors || year AS base FROM cited) SELECT cited, base || CASE WHEN n = 1 THEN '' WHEN n <= 27 THEN chr(CAST(95 + n AS INTEGER)) ELSE '_' || substr(md5(CAST(cited AS VARCHAR)), 1, 6) END AS key FROM (SELECT cited, base, row_number() OVER (PARTITION BY base ORDER BY cited) AS n FROM k)""")
def j12_citekeys(t: Tables) -> DataFrame:
    k = t.cited.select("cited", F.concat("authors", F.col("year").cast("string")).alias("base"))
    n = k.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("cited")))
    mark = F.when(F.col("n") == 1, "").when(F.col("n") <= 27, F.char(95 + F.col("n"))).otherwise(F.concat(F.lit("_"), F.substring(F.md5(F.col("cited").cast("string")), 1, 6)))
    return n.select("cited", F.concat("base", mark).alias("key"))


@query(r"SELECT work_id, regexp_replace(split_part(authors, ',', 1), '[^\p{L}]', '', 'g') || coalesce(CAST(year AS VARCHAR), '') || '_' || substr(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 1, 30) AS key FROM works WHERE title <> ''")
def j12_slugs(t: Tables) -> DataFrame:
    """Keys of author, year and the title's first letters."""
    return t.works.filter("title <> ''").select("work_id", text.citekey(F.col("authors"), F.col("year"), F.col("title")).alias("key"))


@query("SELECT work_id, sha256('w' || work_id || ':' || title || ':0') AS content, substr(sha256('w' || work_id || ':' || title || ':0'), 1, 16) AS short FROM works WHERE title IS NOT NULL")
def j13_hashes(t: Tables) -> DataFrame:
    h = text.content_hash(F.concat(F.lit("w"), F.col("work_id").cast("string")), F.col("title"), F.lit(None))
    return t.works.filter("title is not null").select("work_id", h.alias("content"), F.substring(h, 1, 16).alias("short"))


@query("SELECT CASE WHEN intent IS NULL THEN '' ELSE intent END AS intent, sha256(string_agg(section, ',' ORDER BY section)) AS state FROM (SELECT DISTINCT intent, section FROM fragments) GROUP BY 1")
def j13_state_hash(t: Tables) -> DataFrame:
    return t.fragments.groupBy(F.coalesce("intent", F.lit("")).alias("intent")).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("section")), ","), 256).alias("state"))


@query("SELECT fragment_id, section || '.4' AS deepest, CAST(split_part(section, '.', 1) AS INTEGER) AS chapter FROM fragments")
def j14_section_ids(t: Tables) -> DataFrame:
    s = F.concat(F.lit("ch. 7 see "), "section", F.lit(".4 and 2"))
    return t.fragments.select("fragment_id", text.deepest_section(s).alias("deepest"), F.split_part("section", F.lit("."), F.lit(1)).cast("int").alias("chapter"))


@query("SELECT work_id, CASE WHEN contains(lower(title), 'tion') THEN 'method' WHEN contains(lower(title), 'que') THEN 'theory' WHEN contains(lower(title), 'th') THEN 'results' ELSE 'other' END AS kind, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'ru' ELSE 'other' END AS script FROM works")
def j15_keyword_class(t: Tables) -> DataFrame:
    kind = text.first_hit(F.col("title"), [("tion", "method"), ("que", "theory"), ("th", "results")], "other")
    return t.works.select("work_id", kind.alias("kind"), F.when(F.col("text").rlike("[\\x{0400}-\\x{04FF}]"), "ru").otherwise("other").alias("script"))


@query()
def j18_claims(t: Tables) -> DataFrame:
    draft = F.concat(F.lit('Some 12.5 percent agree [@w1]. "'), F.substring("title", 1, 60), F.lit('" stands there [2]. '), "text")
    c = t.works.select("work_id", F.explode(arrow.claims_udf(draft)).alias("c"))
    return c.select("work_id", "c.*")


@query(r"""WITH s AS (SELECT work_id, unnest([1, 2, 3, 4, 5]) AS n FROM works WHERE length(title) > 20 AND regexp_matches(title, '^[\p{L} ,]*$') AND NOT regexp_matches(title, '^\s|[\s,]$|  ')),
 d AS (SELECT s.work_id, n, title FROM s JOIN works USING (work_id))
 SELECT work_id, CASE n WHEN 5 THEN 'k2' ELSE 'k1' END AS key, CASE n WHEN 1 THEN 'number' WHEN 2 THEN 'quote' WHEN 3 THEN 'definition' ELSE 'none' END AS kind,
  CASE n WHEN 1 THEN (work_id + 7) || '.5 %' WHEN 2 THEN '«' || title || ', and so on and on»' WHEN 3 THEN 'Sea ice refers to what is here .' ELSE '' END AS anchor FROM d""")
def j18_anchors(t: Tables) -> DataFrame:
    """Drafts with a number beside a year and a standard, a quotation, a definition, and two keys of one citation: what each sentence lets be checked."""
    title = F.col("title")
    some = t.works.filter((F.length("title") > 20) & title.rlike(r"^[\p{L} ,]*$") & ~title.rlike(r"^\s|[\s,]$|  ")).withColumn("number", (F.col("work_id") + 7).cast("string"))
    parts = ("---\nkeys: [@no]\n---\nIn 2019 it rose by ", "number", ".5 % (see 72039-2025) [@k1]. They say «", "title", ", and so on and on» [@k1]! Sea ice refers to what is here [@k1]. Nothing of that kind, `[@no]` that is [@k1; @k2].")
    draft = F.concat(*[F.col(p) if p in ("number", "title") else F.lit(p) for p in parts])
    made = some.select("work_id", F.explode(arrow.claim_rows(draft)).alias("c"))
    return made.select("work_id", "c.key", "c.kind", "c.anchor")


@query("SELECT event_id, CASE WHEN amount > 50 THEN 'ok' WHEN amount > 20 THEN 'soft_warn' WHEN operation = 'error' THEN 'hard_warn' ELSE 'unverifiable' END AS verdict FROM usage")
def j20_verdicts(t: Tables) -> DataFrame:
    ladder = F.when(F.col("amount") > 50, "ok").when(F.col("amount") > 20, "soft_warn").when(F.col("operation") == "error", "hard_warn").otherwise("unverifiable")
    return t.usage.select("event_id", ladder.alias("verdict"))


@query("SELECT work_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 2))), ' ') AS words FROM works")
def j25_title_words(t: Tables) -> DataFrame:
    return t.works.select("work_id", F.array_join(F.array_sort(text.title_words(F.col("title"))), " ").alias("words"))


@query("SELECT citing, string_agg(w, ' ' ORDER BY p, w) AS text FROM (SELECT DISTINCT citing, line AS p, intent AS w FROM edges) GROUP BY citing")
def j23_inverted_index(t: Tables) -> DataFrame:
    places = t.edges.groupBy("citing", "intent").agg(F.collect_set("line").alias("ps"))
    index = places.groupBy("citing").agg(F.map_from_entries(F.collect_list(F.struct("intent", "ps"))).alias("index"))
    return index.select("citing", text.from_inverted_index(F.col("index")).alias("text"))


@query("SELECT chapter, printf('%d works in chapter %d', count(*), chapter) AS phrase FROM works GROUP BY chapter")
def j24_phrases(t: Tables) -> DataFrame:
    return t.works.groupBy("chapter").agg(F.count(F.lit(1)).alias("n")).select("chapter", F.format_string("%d works in chapter %d", "n", "chapter").alias("phrase"))


@query("SELECT work_id, datediff('day', DATE '1990-01-01', DATE '1990-01-01' + CAST(work_id AS INTEGER)) AS days, CAST(DATE '2024-03-01' - INTERVAL 14 DAY AS DATE) AS since FROM works")
def l1_dates(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("work_id").cast("int"))
    return t.works.select("work_id", F.datediff(day, F.lit("1990-01-01").cast("date")).cast("long").alias("days"), F.date_sub(F.lit("2024-03-01").cast("date"), 14).alias("since"))


@query("SELECT event_id, greatest(1.0::DOUBLE, least(10.0::DOUBLE, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS DOUBLE), 5.0))) AS score, round_even(event_id / 2.0, 0) AS even FROM usage")
def l2_clamp_and_round(t: Tables) -> DataFrame:
    given = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("amount").cast("string"))
    return t.usage.select("event_id", text.clamp(given, 1.0, 10.0, 5.0).alias("score"), F.bround(F.col("event_id") / F.lit(2.0), 0).alias("even"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM usage")
def l5_json_path(t: Tables) -> DataFrame:
    return t.usage.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT work_id, CASE WHEN '1.' || chapter = section THEN section ELSE '1.' || chapter || ',' || section END AS s FROM works")
def l3_array_functions(t: Tables) -> DataFrame:
    parsed = F.from_json(F.concat(F.lit('["1.'), F.col("chapter").cast("string"), F.lit('", "'), "section", F.lit('", "'), "section", F.lit('"]')), "array<string>")
    return t.works.select("work_id", F.array_join(F.array_distinct(parsed), ",").alias("s"))


@query("""SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || '}' AS json FROM usage""")
def l4_repair_json(t: Tables) -> DataFrame:
    chatty = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", "}", ",}"), F.lit("\n```"))
    return t.usage.select("event_id", arrow.repair_json_udf(chatty).alias("json"))


@query("SELECT work_id, text || ',}' AS said, (length(text) - length(replace(replace(replace(text, '}', ''), ']', ''), ',', '')))::BIGINT + 2 AS marks, 3::BIGINT AS items FROM works WHERE text <> ''")
def l4_strings_kept(t: Tables) -> DataFrame:
    """Whole texts as strings of an answer that needs mending: what they say comes back as it was, line ends, commas and braces too."""
    said = F.concat("text", F.lit(",}"))
    # what JSON asks for but the line ends, which answers often hold as they are
    spelled = F.regexp_replace(F.regexp_replace(said, r"\\", r"\\\\"), '"', r'\\"')
    answer = F.concat(F.lit('Sure, {as asked}:\n```json\n{"said": "'), spelled, F.lit('", "list": [1, 2, [3,],], }\n``` {done}'))
    made = t.works.filter("text <> ''").select("work_id", F.from_json(arrow.repair_json_udf(answer), "said string, list array<string>").alias("j"))
    marks = F.length("j.said") - F.length(F.translate("j.said", "}],", ""))
    return made.select("work_id", "j.said", marks.cast("long").alias("marks"), F.size("j.list").cast("long").alias("items"))


@query("SELECT status, CASE status WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'again' WHEN 'skipped' THEN 'again' ELSE 'open' END AS label, count(*) AS n FROM works GROUP BY 1, 2")
def l7_vocabulary(t: Tables) -> DataFrame:
    names = t.spark.sql("SELECT * FROM VALUES ('completed', 'done'), ('failed', 'again'), ('skipped', 'again') AS v(status, label)")
    return t.works.join(F.broadcast(names), "status", "left").groupBy("status", F.coalesce("label", F.lit("open")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _chunks_sql(texts: str, more: str = "") -> str:
    """Chunks of ``texts`` (work_id, t): each ends at the last sentence end within 500 of 25,000 characters, the next begins 2,000 before."""
    end = r"CASE WHEN {s} + 25000 >= length(t) THEN length(t) WHEN regexp_matches(substr(t, {s} + 24501, 1000), '(?s)[.!?]\s') THEN {s} + 24500 + length(regexp_extract(substr(t, {s} + 24501, 1000), '(?s)^(.*[.!?])\s', 1)) ELSE {s} + 25000 END"
    first, then = end.format(s="0"), end.format(s="greatest(e - 2000, s + 1)")
    return f"""WITH RECURSIVE x AS ({texts}), c AS (SELECT x.*, CAST(0 AS BIGINT) AS s, CAST({first} AS BIGINT) AS e FROM x WHERE length(t) > 0
 UNION ALL SELECT * REPLACE (greatest(e - 2000, s + 1) AS s, CAST({then} AS BIGINT) AS e) FROM c WHERE e < length(t))
 SELECT work_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end"{more} FROM c"""


@query(_chunks_sql("SELECT work_id, text AS t FROM works"))
def f7_chunks(t: Tables) -> DataFrame:
    c = t.works.select("work_id", F.explode(arrow.chunks_udf("text")).alias("c"))
    return c.select("work_id", "c.start", "c.end")


_PAGED = "SELECT work_id, '[Page 1]' || chr(10) || text || chr(10) || chr(10) || '[Page 2]' || chr(10) || title || chr(10) || chr(10) || '[Page 3]' || chr(10) || text AS t, 11 + length(text) AS p2, 22 + length(text) + length(title) AS p3 FROM works"


@query(_chunks_sql(_PAGED, ", CASE WHEN s >= p3 THEN 3 WHEN s >= p2 THEN 2 ELSE 1 END AS page"))
def f7_paged_chunks(t: Tables) -> DataFrame:
    """Chunks of texts in pages: where each starts, and on which page."""
    pages = F.concat(F.lit("[Page 1]\n"), "text", F.lit("\n\n[Page 2]\n"), "title", F.lit("\n\n[Page 3]\n"), "text")
    c = t.works.select("work_id", F.explode(arrow.chunks_udf(pages)).alias("c"))
    return c.select("work_id", "c.start", "c.end", "c.page")


# locators, numbers, notes, sections


@query(r"""WITH b AS (SELECT work_id, CASE WHEN work_id % 7 <> 0 THEN work_id % 50 END AS page, title || chr(10) || CASE work_id % 3 WHEN 0 THEN ' ' || section || '.2 Rule' WHEN 1 THEN 'Таблица А.' || chapter ELSE 'plain 2.5' END || chr(10) || title || chr(10) || CASE WHEN work_id % 2 = 0 THEN 'приложение б Rest' ELSE '12 items' END || chr(10) || lang AS body FROM works),
 p AS (SELECT *, unnest([0, CAST(length(body) // 2 AS INTEGER), CAST(length(body) AS INTEGER)]) AS place, unnest([0, 1, 2]) AS nth FROM b),
 u AS (SELECT *, string_split(substr(body, 1, place) || split_part(substr(body, place + 1), chr(10), 1), chr(10)) AS lines FROM p),
 m AS (SELECT *, list_filter(list_transform(lines, lambda x: CASE WHEN regexp_extract(x, '^\s*(\d+(?:\.\d+)+)(?:\b|$)', 1) <> '' THEN 'п. ' || regexp_extract(x, '^\s*(\d+(?:\.\d+)+)(?:\b|$)', 1)
   WHEN regexp_extract(x, '(?i)^\s*таблица\s+([А-ЯA-Z]?\.?\d+(?:\.\d+)*)(?:\b|$)', 1) <> '' THEN 'табл. ' || regexp_extract(x, '(?i)^\s*таблица\s+([А-ЯA-Z]?\.?\d+(?:\.\d+)*)(?:\b|$)', 1)
   WHEN regexp_extract(x, '(?i)^\s*приложение\s+([А-ЯA-Z])(?:[^\p{L}\p{N}_]|$)', 1) <> '' THEN 'Приложение ' || upper(regexp_extract(x, '(?i)^\s*приложение\s+([А-ЯA-Z])(?:[^\p{L}\p{N}_]|$)', 1)) END), lambda x: x IS NOT NULL) AS found FROM u)
 SELECT work_id, nth, coalesce(found[-1], 'с. ' || page) AS locator FROM m""")
def j16_locators(t: Tables) -> DataFrame:
    """How three places of every text are cited: its beginning, its middle and its end."""
    second = F.when(F.col("work_id") % 3 == 0, F.concat(F.lit(" "), "section", F.lit(".2 Rule"))).when(F.col("work_id") % 3 == 1, F.concat(F.lit("Таблица А."), F.col("chapter").cast("string"))).otherwise("plain 2.5")
    fourth = F.when(F.col("work_id") % 2 == 0, "приложение б Rest").otherwise("12 items")
    body = F.concat_ws("\n", "title", second, "title", fourth, "lang")
    b = t.works.select("work_id", F.when(F.col("work_id") % 7 != 0, F.col("work_id") % 50).alias("page"), body.alias("body"))
    p = b.select("*", F.posexplode(F.array(F.lit(0), F.floor(F.length("body") / 2).cast("int"), F.length("body"))).alias("nth", "place"))
    return p.select("work_id", "nth", text.locator(F.col("body"), F.col("place"), F.col("page")).alias("locator"))


@query(r"""WITH s AS (SELECT work_id, 'x 10,5; v0.674 and 52.27.759, 1 999; ' || coalesce(year, 7) || ' of ' || title || ' 3.' AS src FROM works), r AS (SELECT *, unnest(['0,674 mg', '10.5', '27', '52.27', '759', '1999', 'none', '~3', '74']) AS raw FROM s),
 n AS (SELECT *, regexp_extract(raw, '(\d+)(?:[.,](\d+))?', 1) AS a, regexp_extract(raw, '(\d+)(?:[.,](\d+))?', 2) AS b FROM r)
 SELECT work_id, raw, CASE WHEN a <> '' THEN nullif(regexp_extract(src, '(?:^|[^0-9.,]|(?:^|[^0-9])[.,])(' || a || CASE WHEN b <> '' THEN '[.,]' || b ELSE '' END || ')(?:$|[^0-9.,]|[.,](?:$|[^0-9]))', 1), '') END AS found FROM n""")
def j19_numbers_in_source(t: Tables) -> DataFrame:
    """Numbers as the source spells them: with a point or a comma, and never as a part of a longer one."""
    src = F.concat(F.lit("x 10,5; v0.674 and 52.27.759, 1 999; "), F.coalesce("year", F.lit(7)).cast("string"), F.lit(" of "), "title", F.lit(" 3."))
    raws = F.array(*map(F.lit, ("0,674 mg", "10.5", "27", "52.27", "759", "1999", "none", "~3", "74")))
    r = t.works.select("work_id", src.alias("src"), F.explode(raws).alias("raw"))
    return r.select("work_id", "raw", text.number_in(F.col("raw"), F.col("src")).alias("found"))


_FLAT = r"trim(regexp_replace(regexp_replace(replace({c}, chr(173), ''), '-[\r\n]+', '', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT work_id, text, {_FLAT.format(c='text')} AS flat, instr({_FLAT.format(c='text')}, {_FLAT.format(c='title')}) AS pos FROM works WHERE title <> ''),
 p AS (SELECT *, CAST(floor((pos - 1) * length(text) / greatest(length(flat), 1)) AS BIGINT) AS place FROM f)
 SELECT work_id, CASE WHEN pos > 0 THEN substr(text, greatest(place - 400, 0) + 1, least(place + 400, length(text)) - greatest(place - 400, 0)) ELSE substr(text, 1, 800) END AS passage FROM p""")
def j19_passages(t: Tables) -> DataFrame:
    """What stands around each work's title in its text, its place taken from the squeezed text by proportion."""
    w = t.works.filter("title <> ''").select("work_id", "text", text.squeeze(F.col("text")).alias("flat"), text.squeeze(F.col("title")).alias("anchor"))
    found = w.withColumn("nth", F.position("anchor", "flat"))
    place = F.floor((F.col("nth") - 1) * F.length("text") / F.greatest(F.length("flat"), F.lit(1)))
    near = text.window(F.col("text"), place, place, 400)
    return found.select("work_id", F.when(F.col("nth") > 0, near).otherwise(F.substring("text", 1, 800)).alias("passage"))


@query("SELECT work_id, instr(text, title) - 1 AS start, substr(text, greatest(instr(text, title) - 401, 0) + 1, least(instr(text, title) - 1 + length(title) + 400, length(text)) - greatest(instr(text, title) - 401, 0)) AS passage FROM works WHERE title <> ''")
def j19_exact_passages(t: Tables) -> DataFrame:
    """What stands around each work's title, at its very place: the squeezed text keeps where its characters come from."""
    w = t.works.filter("title <> ''").select("work_id", "text", arrow.squeezed_place_udf(F.col("title"), F.col("text")).alias("s"))
    return w.select("work_id", F.col("s.start").cast("long").alias("start"), text.window(F.col("text"), F.col("s.start"), F.col("s.end"), 400).alias("passage"))


@query("""WITH v AS (SELECT work_id, title || ' ' || lang AS body, CAST(length(title) AS INTEGER) AS n FROM works),
 x AS (SELECT work_id, body, unnest([n, 2, n, 2, 900000]) AS pos, unnest([1, 2, 3, 4, 5]) AS i, unnest(['hard_warn', 'soft_warn', 'hard_warn', 'ok', 'error']) AS severity, unnest(['k1', 'k-->2', 'k1', 'k3', 'k4']) AS k FROM v),
 y AS (SELECT *, least(pos, length(body)) AS place, CASE WHEN severity = 'soft_warn' THEN '<!-- check: check what supports @' ELSE '<!-- check: unsupported by @' END || replace(replace(k, '--', '-'), '>', ' ') || CASE WHEN severity = 'soft_warn' THEN '' ELSE ': raw-  text' END || ' -->' AS note FROM x WHERE severity <> 'ok' AND i <> 3),
 z AS (SELECT work_id, body, list(lpad(CAST(place AS VARCHAR), 9, '0') || '|' || note ORDER BY place DESC, i) AS notes FROM y GROUP BY work_id, body)
 SELECT work_id, list_reduce(list_prepend(body, notes), lambda a, b: substr(a, 1, CAST(substr(b, 1, 9) AS INTEGER)) || substr(b, 11) || substr(a, CAST(substr(b, 1, 9) AS INTEGER) + 1)) AS body FROM z""")
def j22_annotated_drafts(t: Tables) -> DataFrame:
    """Drafts with comments behind their doubtful anchors; repeated verdicts are noted once, places beyond the end stand at the end."""
    n = F.length("title")
    rows = ((n, "hard_warn", "k1"), (F.lit(2), "soft_warn", "k-->2"), (n, "hard_warn", "k1"), (F.lit(2), "ok", "k3"), (F.lit(900_000), "error", "k4"))
    verdicts = F.array(*[F.struct(F.lit(0).alias("start"), end.cast("int").alias("end"), F.lit(key).alias("key"), F.lit(severity).alias("severity"), F.lit("raw-->\ntext").alias("raw")) for end, severity, key in rows])
    return t.works.select("work_id", text.annotated(F.concat_ws(" ", "title", "lang"), verdicts).alias("body"))


_DRAFT = "'## 1 First' || chr(10) || 'intro ' || lang || chr(10) || '### 1.' || chapter || ' ' || title || chr(10) || chr(10) || 'body ' || work_id || chr(10) || '### Prose heading' || chr(10) || 'more' || chr(10) || '### 1.9 Last' || chr(10) || 'x' || chr(10) || '## 2 End'"


def _drafts(t: Tables) -> DataFrame:
    c = F.col("chapter").cast("string")
    draft = F.concat(F.lit("## 1 First\nintro "), "lang", F.lit("\n### 1."), c, F.lit(" "), "title", F.lit("\n\nbody "), F.col("work_id").cast("string"), F.lit("\n### Prose heading\nmore\n### 1.9 Last\nx\n## 2 End"))
    return t.works.select("work_id", "lang", "title", c.alias("chapter"), draft.alias("draft"))


@query("SELECT work_id, 'body ' || work_id || chr(10) || '### Prose heading' || chr(10) || 'more' AS body, 'intro ' || lang || chr(10) || '### 1.' || chapter || ' ' || title || chr(10) || chr(10) || 'body ' || work_id || chr(10) || '### Prose heading' || chr(10) || 'more' || chr(10) || '### 1.9 Last' || chr(10) || 'x' AS chapter_body, CAST(NULL AS VARCHAR) AS absent FROM works")
def j21_section_bodies(t: Tables) -> DataFrame:
    """A section ends at the next numbered heading of its level or above; headings in prose belong to it."""
    d = F.col("draft")
    return _drafts(t).select("work_id", text.section_body(d, F.concat(F.lit("1."), "chapter")).alias("body"), text.section_body(d, F.lit("1")).alias("chapter_body"), text.section_body(d, F.lit("7.7")).alias("absent"))


@query(f"SELECT work_id, replace({_DRAFT}, chr(10) || 'body ' || work_id || chr(10) || '### Prose heading' || chr(10) || 'more' || chr(10), chr(10) || 'new text' || chr(10) || chr(10)) AS replaced, {_DRAFT} || chr(10) || chr(10) || '### 7.7 Extra' || chr(10) || chr(10) || 'new text' || chr(10) AS added FROM works")
def j21_replaced_sections(t: Tables) -> DataFrame:
    section = F.concat(F.lit("1."), "chapter")
    body = F.concat(F.lit("\n### "), section, F.lit(" Old title\n\nnew text\n\n"))
    made = text.with_section(F.col("draft"), section, body, F.lit(None).cast("string"))
    return _drafts(t).select("work_id", made.alias("replaced"), text.with_section(F.col("draft"), F.lit("7.7"), F.lit("new text"), F.lit("Extra")).alias("added"))


@query("SELECT work_id, unnest([0, 2, 5, 7, 9]) AS line, unnest([2, 3, 3, 3, 2]) AS level, unnest(['1', '1.' || chapter, 'prose-heading', '1.9', '2']) AS section_id, unnest(['First', CASE WHEN title = '' THEN '1.' || chapter ELSE title END, 'Prose heading', 'Last', 'End']) AS title FROM works")
def j21_headings(t: Tables) -> DataFrame:
    h = _drafts(t).select("work_id", F.explode(text.headings(F.col("draft"))).alias("h"))
    return h.select("work_id", "h.line", "h.level", "h.section_id", "h.title")


@query("""SELECT work_id, 'w' || work_id AS key, 'It is 0.5 of ' || lang || ' here [@w' || work_id || '] and on.' AS sentence FROM works
 UNION ALL SELECT work_id, '2', 'Last one says ' || lang || ' [2]' FROM works""")
def j17_sentences(t: Tables) -> DataFrame:
    """The sentence of every citation: dots between digits end none, headings do, code and front matter cite nothing."""
    w = F.concat(F.lit("w"), F.col("work_id").cast("string"))
    draft = F.concat(F.lit("---\nkey: [@no]\n---\nBefore; It is 0.5 of "), "lang", F.lit(" here [@"), w, F.lit("] and on. `[@code]` <!-- [3] -->\n\n# Heading\n\nLast one says "), "lang", F.lit(" [2]\n# Next 4\n"))
    s = t.works.select("work_id", draft.alias("d"), F.explode(arrow.sentences_udf(draft)).alias("s"))
    return s.select("work_id", "s.key", F.expr("substring(d, s.start + 1, s.end - s.start)").alias("sentence"))


@query("SELECT work_id, lang AS language, '7' AS depth, collection AS collection, CASE WHEN work_id % 2 = 0 THEN 'own' ELSE 'base' END AS kind FROM works")
def l6_map_merge(t: Tables) -> DataFrame:
    """Settings of a project over those of the library: inner maps are merged, the nearer value wins."""
    base = F.create_map(F.lit("text"), F.create_map(F.lit("language"), F.lit("en"), F.lit("depth"), F.lit("7")), F.lit("store"), F.create_map(F.lit("kind"), F.lit("base")))
    over = F.create_map(F.lit("text"), F.create_map(F.lit("language"), F.col("lang")), F.lit("name"), F.create_map(F.lit("collection"), F.col("collection")))
    own = F.map_filter(F.create_map(F.lit("store"), F.create_map(F.lit("kind"), F.lit("own"))), lambda k, v: F.col("work_id") % 2 == 0)
    m = text.deep_merged(text.deep_merged(base, over), own)
    at = lambda a, b: F.try_element_at(F.try_element_at("m", F.lit(a)), F.lit(b))
    return t.works.select("work_id", m.alias("m")).select("work_id", at("text", "language").alias("language"), at("text", "depth").alias("depth"), at("name", "collection").alias("collection"), at("store", "kind").alias("kind"))
