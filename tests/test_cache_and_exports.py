from pyspark.sql import functions as F

from athenaeum.operators.cache import Results, state_key
from athenaeum.sources import files


def test_hits_misses_and_invalidation(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).withColumn("run", F.lit(len(made)))

    cache, rows = Results(spark, f"file://{tmp_path}/c"), spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    key = state_key(rows, "id", "t")
    assert key == state_key(rows.distinct().orderBy(F.desc("id")), "id", "t") != state_key(rows.withColumn("t", F.coalesce("t", F.lit(""))), "id", "t")
    assert key != state_key(rows.limit(0), "id", "t")
    first, was_there = cache.get("u/1", "p", key, "o", "m", make)
    again, is_there = cache.get("u/1", "p", key, "o", "m", make)
    assert (was_there, is_there, len(made)) == (False, True, 1) and sorted(first.collect()) == sorted(again.collect())
    for other in (("u/1", "p", key + "x", "o", "m"), ("u/1", "p", key, "o2", "m"), ("u/1", "p", key, "o", "m2"), ("u/1", "q", key, "o", "m"), ("v", "p", key, "o", "m")):
        assert cache.find(*other) is None and not cache.get(*other, make)[1]
    cache.invalidate("u/1", "p")
    assert cache.find("u/1", "p", key, "o", "m") is None and cache.find("u/1", "q", key, "o", "m") is not None
    cache.invalidate("u/1")
    assert cache.find("u/1", "q", key, "o", "m") is None and cache.find("v", "p", key, "o", "m") is not None
    assert not cache.get("u/1", "p", key, "o", "m", make)[1]


def test_the_pointer_is_never_gone(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for i in range(1, 4):
        files.write_swapped(spark.range(i), root, str(i))
        assert files.read_current(spark, root).count() == i
        assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("current")) == ["current"]


def test_exports_come_back(spark, tmp_path):
    fragments = spark.range(80).selectExpr("79 - id AS id", "concat('t \"', id, '\\n') AS text", "id % 101 AS score", "CASE WHEN id % 4 > 0 THEN 'yes' END AS label")
    gaps = spark.range(70).selectExpr("concat('title ', lpad(id, 3, '0')) AS ref_title", "'1.1' AS section", "cast(id % 6 AS int) AS relevance")
    files.export_dataset(fragments, gaps, str(tmp_path / "e"))
    back, wanted = files.read_dataset(spark, str(tmp_path / "e"))
    rows = back.orderBy("id").collect()
    assert len(rows) == 50 and [r.id for r in rows] == [i for i in range(80) if (79 - i) % 4][:50] and rows[0].text == 't "79\n'
    assert {r.id: r.relevance for r in rows}[20] == 5 and all(1 <= r.relevance <= 5 for r in rows)
    got = [(r.relevance, r.ref_title) for r in wanted.collect()]
    assert sorted(got) == sorted(sorted(((i % 6, f"title {i:03d}") for i in range(50)), key=lambda x: (-x[0], x[1]))[:20])
    works = spark.createDataFrame([("k2", "online", "A {title}", "L, F", 2001), ("k1", None, "B", None, None)], "key string, type string, title string, authors string, year int")
    files.write_bibtex(works, str(tmp_path / "b"))
    assert sorted((r.key, r.type, r.fields["title"]) for r in files.read_bibtex(spark, str(tmp_path / "b")).collect()) == [("k1", "misc", "B"), ("k2", "online", "A title")]


def test_page_files_and_marks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("One hyphen-\nated\n12\n\n\n\n\nend\x0cTwo\x00\x0c\x0cFour é".encode() + b"\xff")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.md").write_text("no page")
    pages = files.page_files(spark, str(tmp_path), "*.txt")
    got = {(r.path.rsplit("/", 1)[1], r.page): r.text for r in pages.collect()}
    assert got == {("a.txt", 1): "One hyphenated\n\nend", ("a.txt", 2): "Two", ("a.txt", 3): "", ("a.txt", 4): "Four é�"}
    marked = {r.path.rsplit("/", 1)[1]: r.text for r in files.marked_text(pages).collect()}
    assert marked == {"a.txt": "[Page 1]\nOne hyphenated\n\nend\n\n[Page 2]\nTwo\n\n[Page 3]\n\n\n[Page 4]\nFour é�"}
    assert {len(r.text) for r in files.marked_text(pages, 8).collect()} == {8}


def test_notes_are_taken_apart_and_found(spark, tmp_path):
    for name, text in (("x.md", "---\r\nstate: one\r\ntags: [a, 'b c']\r\nstate: two\r\n---\r\nBody of ICE"), ("y.md", "---\ntags:\n  - \"#d\"\n  - e\nkey: Frost\n---\n"), ("z.md", "--- no front\nice"), ("e.md", "")):
        (tmp_path / name).write_bytes(text.encode())
    read = files.notes(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.front, r.tags, r.body) for r in read.collect()}
    # an empty file has no text and so no note
    assert {k: v for k, v in got.items() if k != "e.md"} == {"x.md": ({"state": "two", "tags": "[a, 'b c']"}, ["a", "b c"], "Body of ICE"), "y.md": ({"tags": "", "key": "Frost"}, ["#d", "e"], ""), "z.md": ({}, [], "--- no front\nice")}
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    assert sorted(names(files.find_notes(read, "ice"))) == ["x.md", "z.md"] and names(files.find_notes(read, "fROST")) == ["y.md"] and len(names(files.find_notes(read, "", 2))) == 2
