import random

import pytest
from pyspark.sql import functions as F

from athenaeum.functions import arrow, text
from athenaeum.sources import files


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_native_text(spark):
    assert one(spark, "a-\nb \t c­d", text.squeeze) == "ab cd"
    assert one(spark, "A – b\n c", text.comparable) == "a - b c"
    assert one(spark, "x\x00-\ny\n12\n\n\n\nz", text.tidy_page) == "xy\n\nz"
    assert one(spark, "see 10.1234/Ab.c/. and", text.doi) == "10.1234/ab.c"
    assert one(spark, "10.0000/x", text.doi) is None
    assert one(spark, "https://doi.org/10.1/X.", text.normalize_doi) == "10.1/x"
    assert one(spark, "Smith, J.; Doe, A.", text.surname) == "Smith" and one(spark, "Jane B. Doe et al.", text.surname) == "Doe"
    assert one(spark, "ch 2, see 2.3.1 or 4.5", text.deepest_section) == "2.3.1"
    assert one(spark, "n/a", lambda c: text.clamp(c, 1, 10, 5)) == 5.0 and one(spark, "99", lambda c: text.clamp(c, 1, 10, 5)) == 10.0
    got = spark.createDataFrame([("Deep Nets for Text", "Deep nets for texts")], "a string, b string").select(text.titles_match(F.col("a"), F.col("b"))).first()[0]
    assert got is True


def test_squeeze_keeps_places():
    made, places = arrow.squeeze_with_places("  ﬁ­ne-\r\nprint \t и\u0306x ")
    assert (made, places) == ("fineprint йx", [2, 2, 4, 5, 9, 10, 11, 12, 13, 14, 17, 19])
    for raw in ("ﬁne  print", "a-\nb", "éte", " x  y ", "", "a­b 𝒳"):
        made, places = arrow.squeeze_with_places(raw)
        assert len(made) == len(places) and made == arrow.squeeze(raw) == arrow.squeeze(made)


def test_locate():
    body = "Intro words here. The quick brown fox jumps over the lazy dog near the river bank today. End."
    quote = "The quick brown fox jumps over the lazy dog near the river bank"
    a, b = arrow.locate(quote, body)
    assert body[a:b] == quote
    a, b = arrow.locate(quote.replace("brown", "brawn"), body)
    assert abs(a - body.index("The quick")) <= 1
    assert arrow.locate("something else entirely, not in there at all", body) is None and arrow.locate("", body) is None


def test_visible_text():
    page = '<html><head><meta charset="utf-8"><title>t</title></head><body><script>x</script><p>A &amp; B</p><div>C<br>D</div></body></html>'
    assert arrow.visible_text(page).split() == ["A", "&", "B", "C", "D"]
    assert arrow.visible_text("<table><tr><td>A1</td><td>B2</td></tr></table>").split() == ["A1", "B2"]
    assert arrow.visible_text('x<a title="1 > 0">y</a><!-- <p>no</p> --><style>p {}</style>z<link href=q> &lt;b&gt;<script>never closed') == "xyz <b>"
    assert arrow.visible_text("<p>a</p>" + "<br>" * 9 + "<p>b</p>") == "a\n\n\nb"


def test_sentences_and_claims():
    t = 'First. It rose 3.5 percent in 2019 [@smith2020]. He said "one two three four five" [2]! Last'
    a, b = arrow.sentence_around(t, t.index("[@"), t.index("[@") + 5)
    assert t[a:b] == "It rose 3.5 percent in 2019 [@smith2020]."
    got = [(c["key"], c["kind"], c["anchor"]) for c in arrow.claims(t)]
    assert got == [("smith2020", "number", "3.5"), ("2", "quote", "one two three four five")]


def test_sentences_end_at_headings_and_skip_code():
    t = "---\na: [@no1]\n---\nIntro text\n# Head\nIt is 52.27.759 or 0.5 here [@yes1] and on\n\n# Next\n`[@no2]` <!-- [@no3] -->Last; one [3]"
    got = [(x["key"], t[x["start"] : x["end"]]) for x in arrow.sentences(t)]
    assert got == [("yes1", "# Head\nIt is 52.27.759 or 0.5 here [@yes1] and on"), ("3", "one [3]")]


def test_misquotations_are_found_wherever_they_differ():
    """Recall of the search by votes: up to a twentieth of the characters changed, at the beginning too."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "of", "man", "ration", "pel") for b in ("", "al", "ty", "ond", "s")]
    found = 0
    for _ in range(120):
        quote = " ".join(rng.choices(words, k=rng.randint(14, 50)))
        changed = list(quote)
        for k in rng.sample(range(len(quote)), max(1, len(quote) // 25)) + [0]:
            changed[k] = rng.choice("abcxyz ")
        body = " ".join(rng.choices(words, k=3000))
        cut = rng.randint(0, len(body))
        got = arrow.locate(quote, body[:cut] + " " + "".join(changed) + " " + body[cut:])
        found += bool(got) and abs(got[0] - cut - 1) <= 3
    assert found >= 0.9 * 120


def test_chunks_cover():
    t = "Some words stand here. " * 4000
    c = arrow.chunks(t)
    assert c[0]["start"] == 0 and c[-1]["end"] == len(t) and all(x["end"] > y["start"] for x, y in zip(c, c[1:]))
    assert arrow.chunks("") == [] and arrow.chunks("short") == [{"start": 0, "end": 5, "page": 1}]
    paged = arrow.chunks("[Page 1]\n" + t + "\n\n[Page 2]\n" + t)
    assert [x["page"] for x in paged] == [1 if x["start"] < len(t) + 11 else 2 for x in paged] and paged[-1]["page"] == 2


def test_json_and_latin():
    assert arrow.repair_json('Sure: ```{"a": [1, 2,], }```') == '{"a": [1, 2]}'
    assert arrow.repair_json("none") is None and arrow.latin("Щука Élan straße") == "shchuka elan strasse"
    assert [arrow.latin(x) for x in ("Фёдоров", "Łukasiewicz", "Þórður", "Müller", "Ħal")] == ["fyodorov", "lukasiewicz", "thordur", "muller", "hal"]


def test_export(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"items": [{"itemType": "book", "citationKey": "k1", "title": " T ", "date": "May 2001", "DOI": "10.1/A", "creators": [{"creatorType": "author", "lastName": "L", "firstName": "F"}, {"creatorType": "editor", "lastName": "E"}], "attachments": [{"path": "a.PDF"}], "tags": [{"tag": "x"}, {"tag": "y"}]}, {"itemType": "note", "citationKey": "n"}, {"itemType": "book"}]}')
    assert [tuple(r) for r in files.reference_export(spark, str(tmp_path / "x.json")).collect()] == [("k1", "T", "L, F", 2001, "10.1/a", "a.PDF", "x, y")]


def test_bibtex_round_trip(spark):
    works = spark.createDataFrame([("k1", "online", "A title", "L, F", 2001), ("k2", None, "B", None, None)], "key string, type string, title string, authors string, year int")
    whole = files.to_bibtex(works).agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    got = {r.key: (r.type, r.fields) for r in files.bibtex(whole).collect()}
    assert got == {"k1": ("online", {"title": "A title", "author": "L, F", "year": "2001"}), "k2": ("misc", {"title": "B"})}


def test_notes_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.md").write_text("---\nstatus: done\ntags: [a, b]\n---\nBody")
    r = files.notes(spark, str(tmp_path)).first()
    assert (r.front["status"], r.tags, r.body) == ("done", ["a", "b"], "Body")
    spans = one(spark, "h\n<!-- Page 3 -->\nabc\n<!-- Page 4 -->\nde", files.pages_of)
    assert [tuple(s) for s in spans] == [(3, 2, 5), (4, 6, 8)]


def test_outline(spark):
    df = spark.createDataFrame([("p", "1. One\n1.1 Sub\nloose\n2 Two\n2.3.4 Deep")], "plan string, text string")
    assert [tuple(r)[1:] for r in files.outline(df, "plan", "text").orderBy("place").collect()] == [(0, "1", 1, "One", "1"), (1, "1.1", 2, "Sub", "1"), (3, "2", 1, "Two", "2"), (4, "2.3.4", 3, "Deep", "2")]


def test_swap(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    files.write_swapped(spark.range(3), root, "1")
    files.write_swapped(spark.range(5), root, "2")
    assert files.read_current(spark, root).count() == 5


def test_locators(spark):
    """The nearest clause, table or appendix from the place's line upwards."""
    body = "1 Scope\n3.4 Terms start here\nplain text\nТаблица А.1 — names\nrows\nприложение б\nend 2.5 mm"
    at = lambda what: body.index(what)
    rows = [(body, at("Scope"), 7), (body, at("start"), 7), (body, at("plain"), 7), (body, at("rows"), 7), (body, at("end"), None), (body, 10_000, 7), ("", 0, 7), ("no mark", 3, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, s int, p int").select(text.locator(F.col("t"), F.col("s"), F.col("p"))).collect()]
    assert got == ["с. 7", "п. 3.4", "п. 3.4", "табл. А.1", "Приложение Б", "Приложение Б", "с. 7", None]


def test_numbers_in_a_source(spark):
    source = "rates of 0,674 and 10.85; clause 52.27.759, 8 items"
    cases = {"0.674 %": "0,674", "0.8": None, "10,85": "10.85", "27": None, "759": None, "8": "8", "none": None, "52": None}
    rows = spark.createDataFrame([(k, source) for k in cases], "raw string, source string")
    assert {r.raw: r.found for r in rows.select("raw", text.number_in(F.col("raw"), F.col("source")).alias("found")).collect()} == cases


def test_sections_of_drafts(spark):
    draft = "# 1 One\nintro\n## 1.1 Sub\nbody\n### Prose\nmore\n## 1.10 Other\nlast"
    assert one(spark, draft, lambda c: text.section_body(c, F.lit("1.1"))) == "body\n### Prose\nmore"
    assert one(spark, draft, lambda c: text.section_body(c, F.lit("1.10"))) == "last" and one(spark, draft, lambda c: text.section_body(c, F.lit("2"))) is None
    put = lambda i, b: one(spark, draft, lambda c: text.with_section(c, F.lit(i), F.lit(b), F.lit("New")))
    assert put("1.1", "## 1.1 Sub\nfresh") == "# 1 One\nintro\n## 1.1 Sub\n\nfresh\n\n## 1.10 Other\nlast"
    assert put("3.2", "fresh") == draft + "\n\n### 3.2 New\n\nfresh\n"
    assert [tuple(h) for h in one(spark, draft + "\n# Some Words!", text.headings)][-1] == (1, "some-words", "Some Words!", 8)


def test_notes_in_drafts(spark):
    verdicts = [(0, 5, "k", "hard_warn", "a --> b"), (0, 5, "k", "error", "again"), (6, 9, "m", "soft_warn", ""), (6, 9, "n", "ok", ""), (0, 99, "z", "error", "x\ny")]
    df = spark.createDataFrame([("alpha beta", verdicts), ("none", [])], "t string, v array<struct<start:int,end:int,key:string,severity:string,raw:string>>")
    got = [r[0] for r in df.select(text.annotated(F.col("t"), F.col("v"))).collect()]
    assert got == ["alpha<!-- check: unsupported by @k: a -  b --> bet<!-- check: check what supports @m -->a<!-- check: unsupported by @z: x y -->", "none"]


def test_abstracts(spark):
    cases = {
        "Title\nAbstract\nOne\n two.\n\nRest": "One two.", "x АННОТАЦИЯ: Кратко. Ключевые слова: a": "Кратко.", "Резюме\nЭто\nВведение\n": "Это",
        "Abstract. It is.\n1 Intro": "It is.", "no heading": "", "Abstract without an end": "", "y" * 20_000 + "\nAbstract\nlate\n\n": "late",
    }
    assert {k: one(spark, k, text.abstract) for k in cases} == cases


def test_malformed_files_are_errors(spark):
    gold = lambda d: files.gold_documents(spark.createDataFrame([("doc7", d)], "n string, d string"), "n", "d").collect()
    good = gold('{"frame_pages": [2, 4], "claims": [{"quote": "q"}]}')
    assert (good[0].citekey, good[0].first_page, good[0].last_page) == ("doc7", 2, 4)
    for bad in ('{"frame_pages": [4, 2], "claims": [{"quote": "q"}]}', '{"claims": [{"quote": "q"}]}', '{"frame_pages": [1, 2], "claims": []}', '{"frame_pages": [1, 2], "claims": [{"quote": " "}]}', "{"):
        with pytest.raises(Exception):
            gold(bad)
    entries = files.upload_entries(spark.createDataFrame([('{"items": [{"itemType": "book", "citationKey": "k", "DOI": " HTTPS://doi.org/10.1/A ", "date": "Spring 2023", "creators": [{"creatorType": "editor", "lastName": "E"}, {"creatorType": "author", "lastName": " L "}]}, {"itemType": "note", "citationKey": "n"}, {"title": "no key"}]}',)], "data string"))
    assert [tuple(r) for r in entries.collect()] == [("k", "10.1/a", "", "L", 2023)]
    batch = files.acquisition_batch(spark.createDataFrame([('[{"url": "u", "volume": 3}, {}]',)], "data string"))
    assert [(r.url, r.title, r.year, r.volume, r.sections) for r in batch.collect()] == [("u", "", None, "3", []), ("", "", None, "", [])]


def test_maps(spark):
    df = spark.createDataFrame([({"a": {"x": "1", "y": "2"}, "b": {"z": "3"}}, {"a": {"y": "9"}, "c": {"w": "4"}})], "m map<string,map<string,string>>, n map<string,map<string,string>>")
    assert df.select(text.deep_merged(F.col("m"), F.col("n"))).first()[0] == {"a": {"x": "1", "y": "9"}, "b": {"z": "3"}, "c": {"w": "4"}}


def test_places_are_kept_as_four_bytes(spark):
    from athenaeum.functions import arrow

    df = spark.createDataFrame([(1, "a  b-\nc ﬁ"), (2, None), (3, ""), (4, "x")], "id long, t string")
    got = {r.id: r.m and (r.m.text, r.m.places) for r in df.select("id", arrow.squeeze_with_places_udf("t").alias("m")).collect()}
    want = {i: (lambda p: (p[0], list(p[1])))(arrow.squeeze_with_places(t)) for i, t in ((1, "a  b-\nc ﬁ"), (3, ""), (4, "x"))}
    assert got == want | {2: None}
