import math

import pytest
from pyspark.sql import functions as F

from athenaeum.operators import evaluation, matching, merge, scoring, vectors


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, None, 3)], "id int, s string, n int")
    new = spark.createDataFrame([(2, "", 5), (3, "z", None), (4, "w", 9)], "id int, s string, n int")
    assert rows(merge.insert_ignore(old, new, ["id"])) == [(1, "a", 1), (2, "b", None), (3, None, 3), (4, "w", 9)]
    assert rows(merge.insert_replace(old, new, ["id"], ["n"])) == [(1, "a", 1), (2, "", 5), (3, "z", None), (4, "w", 9)]
    assert rows(merge.upsert(old, new, ["id"], {"s": merge.fill_text, "n": merge.fill})) == [(1, "a", 1), (2, "b", 5), (3, "z", 3), (4, "w", 9)]
    assert rows(merge.upsert(old, new, ["id"], {"s": merge.backfill(["z"]), "n": merge.keep_old})) == [(1, "a", 1), (2, "b", None), (3, "z", 3), (4, "w", 9)]
    assert rows(merge.replace_partitions(old, new, ["id"])) == [(1, "a", 1), (2, "", 5), (3, "z", None), (4, "w", 9)]
    assert rows(merge.diff(old, new, "id", ["s", "n"])) == [(1, "gone"), (2, "updated"), (3, "updated"), (4, "new")]
    assert merge.insert_ignore(old.limit(0), new, ["id"]).count() == 3


def test_merge_twice_is_once(spark):
    old = spark.createDataFrame([(1, "a")], "id int, s string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, s string")
    once = merge.insert_replace(old, new, ["id"], ["s"])
    assert rows(merge.insert_replace(once, new, ["id"], ["s"])) == rows(once)


def test_stale_and_prefix(spark):
    claims = spark.createDataFrame([("m", "h1", False), ("m", "h2", False), ("x", "h3", False)], "doc string, h string, stale boolean")
    live = spark.createDataFrame([("h1",)], "h string")
    assert rows(merge.mark_missing(claims, live, F.col("doc") == "m", "h", "stale")) == [("m", "h1", False), ("m", "h2", True), ("x", "h3", False)]
    assert [r[2] for r in rows(merge.mark_missing(claims, live.limit(0), F.col("doc") == "m", "h", "stale"))] == [True, True, False]
    s = spark.createDataFrame([("2.1.3",), ("2.10",), ("2",), (None,)], "section string")
    types = spark.createDataFrame([("2", "theory"), ("2.1", "terms")], "prefix string, type string")
    assert dict(merge.longest_prefix(s, types, "section").collect()) == {"2.1.3": "terms", "2.10": "theory", "2": "theory", None: None}


def test_matching(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "entry int, k string")
    lib = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "k string, work int")
    assert rows(matching.exactly_one(left, lib, "entry", "k", "work")) == [(1, 1, 10, "matched"), (2, 2, None, "ambiguous"), (3, 0, None, "unmatched")]
    tier = lambda *r: spark.createDataFrame(list(r), "ref int, work int, confidence double")
    got = matching.cascade("ref", [tier((1, 5, 1.0)), tier((1, 2, 0.7), (2, 9, 0.7), (2, 3, 0.7))], ["work"])
    assert rows(got.select("ref", "work", "tier")) == [(1, 5, 0), (2, 3, 1)]
    dup = spark.createDataFrame([(1, "x", "t"), (2, "x", "u"), (3, None, "t"), (4, None, None)], "id int, doi string, title string")
    assert rows(matching.duplicate_pairs(dup, "id", [(F.col("doi"), 1.0), (F.col("title"), 0.7)])) == [(1, 2, 1.0), (1, 3, 0.7)]


def test_intervals(spark):
    a = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 500, 900), ("e", 3, 5, 6)], "doc string, id int, s long, e long")
    b = spark.createDataFrame([("d", 7, 9, 501), ("d", 8, 10, 11), ("e", 9, 6, 7)], "doc string, id2 int, s2 long, e2 long")
    assert rows(matching.overlaps(a, b, ["doc"], 64).select("id", "id2")) == [(1, 7), (2, 7)]
    spans = spark.createDataFrame([("d", 0, 5), ("d", 5, 8), ("d", 2, 3), ("d", 20, 30)], "doc string, s long, e long")
    totals = spark.createDataFrame([("d", 40), ("e", 0), ("f", 9)], "doc string, total long")
    assert rows(matching.union_coverage(spans, "doc", totals)) == [("d", 40, 18, 2, 18 / 40), ("e", 0, 0, 0, 1.0), ("f", 9, 0, 0, 0.0)]
    facts = spark.createDataFrame([("d", 1, 5), ("d", 2, 10), ("d", 3, 1)], "doc string, f int, at long")
    marks = spark.createDataFrame([("d", 2, "p1"), ("d", 10, "p2")], "doc string, pos long, page string")
    assert rows(matching.as_of(facts, marks, "doc", "at", "pos", "page").select("f", "page")) == [(1, "p1"), (2, "p2"), (3, None)]


def test_vectors(spark):
    v = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], []), ([1.0], [1.0, 0.0])]
    got = [r[0] for r in spark.createDataFrame(v, "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1, 0, -1, 0, 0, 0])
    c = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0]), (1, [9.0])], "section int, v array<double>")
    assert rows(vectors.centroid(c, "section", 2)) == [(1, [2.0, 4.0], 2)]


def test_signature_recall(spark):
    """Pairs by signature are exact pairs, and nearly all of those well above the threshold."""
    from athenaeum.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001").vectors.filter("id < 200")
    found = {(r.a, r.b) for r in vectors.similar_pairs(t, 0.3, 64, tables=24, bits=4).collect()}
    a, b = t.select(F.col("id").alias("a"), F.col("section").alias("s"), F.col("v").alias("x")), t.select(F.col("id").alias("b"), F.col("section").alias("u"), F.col("v").alias("y"))
    exact = {(r.a, r.b) for r in a.join(b, (F.col("a") < F.col("b")) & (F.col("s") != F.col("u"))).filter(vectors.cosine(F.col("x"), F.col("y")) >= 0.3).select("a", "b").collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_scores(spark):
    edges = spark.createDataFrame([(1, 7, "method"), (2, 7, None), (2, 7, "background"), (3, 8, None)], "citing int, cited int, intent string")
    quality = spark.createDataFrame([(1, 5)], "citing int, quality int")
    assert rows(scoring.gap_scores(edges, quality).select("cited", "score")) == [(7, pytest.approx(2 * (11 / 3) * (5 / 3))), (8, 3.0)]
    assert rows(scoring.gap_scores(edges, quality, unknown=None).select("cited", "score")) == [(7, pytest.approx(2 * (11 / 3) * 2)), (8, 3.0)]
    y = spark.createDataFrame([(None, 0), (0, 0), (2020, 0), (1990, 50), (1990, 1)], "year int, n int")
    assert [r[0] for r in y.select(scoring.recent_or_classic(F.col("year"), F.col("n"), 2025, 10, 10)).collect()] == [True, True, True, True, False]


def test_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("a", "z")], "predicted string, actual string")
    got = {r["class"]: r for r in evaluation.class_metrics(pairs, ["a", "b", "c"]).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].recall, got["c"].f1) == (0.5, 0.5, 0.5, 0.0)
    ranked = spark.createDataFrame([("q", "x", 3.0), ("q", "x", 2.0), ("q", "y", 1.0)], "query string, item string, score double")
    relevant = spark.createDataFrame([("q", "y", 2), ("q", "z", 1)], "query string, item string, gain int")
    r = evaluation.retrieval(ranked, relevant, 2).first()
    assert (r.precision, r.recall) == (0.5, 0.5) and r.ndcg == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    truth = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "c")], "section string, key string")
    assert [tuple(x)[1:] for x in evaluation.set_metrics(truth, truth, "section", "key").collect()] == [(1.0, 1.0, 1.0)] * 2
    a = spark.createDataFrame([("f1", 0.5), ("only", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("f1", 0.75)], "metric string, value double")
    assert rows(evaluation.compare_runs(a, b)) == [("f1", 0.5, 0.75, 0.25), ("only", 1.0, None, None)]


def test_duplicate_pairs_are_made_once_and_never_shuffled(spark, monkeypatch):
    from athenaeum.operators import matching

    monkeypatch.setattr(matching, "SPLIT", 4)
    data = [(i, "hot" if i % 2 else f"p{i % 5}", None if i % 7 == 0 else f"q{i % 3}") for i in range(60)] + [(3, "p1", "q9"), (4, "hot", "q9"), (5, "hot", "q2"), (None, "hot", "q1")]
    df = spark.createDataFrame(data, "id long, p string, q string")
    made = matching.duplicate_pairs(df, "id", [(F.col("q"), 0.7), (F.col("p"), 1.0)])
    want = {}
    for column, confidence in ((1, 1.0), (2, 0.7)):
        for x in data:
            for y in data:
                if None not in (x[0], y[0], x[column]) and x[0] < y[0] and x[column] == y[column]:
                    want.setdefault((x[0], y[0]), confidence)
    got = made.collect()
    assert {(r.a, r.b): r.confidence for r in got} == want and len(got) == len(want)
    # no pair is grouped: what is grouped are keys, below the joins
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_rows_of_a_hot_key_are_sent_as_often_however_many_they_are(spark, monkeypatch):
    from athenaeum.operators import matching
    from athenaeum.sources.tables import Tables

    monkeypatch.setattr(matching, "SPLIT", 4)
    monkeypatch.setattr(matching, "PARTS", 3, raising=False)
    monkeypatch.setattr(matching, "LISTED", 5, raising=False)
    sent, dealt = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *by: (sent.append(self), dealt(self, *by))[1])
    for n in (63, 252):
        sent.clear()
        df = spark.range(n).select("id", F.lit("hot").alias("p"), (F.col("id") % 7).alias("q"))
        got = matching.duplicate_pairs(df, "id", [(F.col("p"), 0.5), (F.col("q"), 0.9)]).collect()
        assert {(r.a, r.b): r.confidence for r in got} == {(a, b): 0.9 if a % 7 == b % 7 else 0.5 for a in range(n) for b in range(a + 1, n)} and len(got) == n * (n - 1) // 2
        # a row of both keys, in three parts each
        assert sent and sum(d.count() for d in sent) == 2 * n * (matching.PARTS + 1)
    # texts aren't shuffled to find labels
    plan = Tables(spark, "/root/testdata/sf0.001").works.select("title", "quality")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_extract")


def test_pairs_of_works_need_no_labels(spark, tmp_path):
    import __spark_entry__ as entry

    texts = [(i, f"{'A title of some length' if i % 2 else f'Another one, the {i % 4}th'}. Text {i}") for i in range(50)] + [(51, None), (None, "A title of some length")]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = entry.queries()["d11_duplicate_pairs"](spark, str(tmp_path))
    alike = lambda i: "odd" if i % 2 else i % 4
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(50) for a in range(b) if alike(a) == alike(b)}


def test_what_a_task_holds_does_not_grow(spark, monkeypatch):
    """Spans are dealt to more tasks the more they are, and sections are grouped in their tasks before they meet."""
    from athenaeum.operators import matching
    from athenaeum.operators.matching import union_coverage
    from athenaeum.plans.analytics import i2_intersect
    from athenaeum.sources.tables import Tables

    spans = spark.createDataFrame([(1, 0, 5), (1, 0, 9), (1, 0, 9), (1, 9, 10), (1, 20, 21), (2, 3, 4)], "doc long, s long, e long")
    totals = spark.createDataFrame([(1, 22), (2, 0), (3, 5)], "doc long, total int")
    monkeypatch.setattr(matching, "SORTED", 1)
    made = union_coverage(spans, "doc", totals)
    assert sorted((r.doc, r.covered, r.islands) for r in made.collect()) == [(1, 11, 2), (2, 1, 1), (3, 0, 0)]
    assert "RepartitionByExpression [doc" in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and ", 6" in plan
    # labels join the works; sections themselves meet by grouping, of which each task sends its own
    plan = i2_intersect(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and plan.count("Aggregate") == 1


def test_union_coverage_hangs_on_no_order_of_equal_spans(spark, tmp_path):
    """Spans without an end, quantities that are no whole numbers and suppliers listed twice are as in the SQL; equal spans are sorted once."""
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    lines = [(1, 1, 5.0), (1, 1, 12.0), (1, 2, 2.5), (1, 3, 3.5), (1, 9, None), (1, None, 4.0), (2, 7, None), (2, 8, 10.0), (2, 9, 1.0), (None, 1, 1.0), (3, 4, None), (5, 4, 40.0), (5, 5, 2.0)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (3,), (4,), (None,), (None,), (5,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as c:
        for name in ("lineitem", "supplier"):
            c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        want = c.execute(entry.oracle_sql()["e27_interval_union"]).fetchall()
    made = entry.queries()["e27_interval_union"](spark, str(tmp_path))
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    # two windows could each put equal spans in an order of its own, so there is one
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    equal = spark.createDataFrame([(1, 0, 5)] * 3 + [(1, 7, 7)] * 2 + [(1, 9, 12)] * 4 + [(1, 11, 15)] * 2, "doc long, s long, e long")
    assert rows(matching.union_coverage(equal, "doc", spark.createDataFrame([(1, 20)], "doc long, total int"))) == [(1, 20, 11, 3, 0.55)]


def test_gap_scores_are_dealt_by_their_number(spark, monkeypatch):
    """Citations are dealt to more tasks the more they are, and meet nothing and are not grouped before; what is scored is as it was."""
    from athenaeum.operators import sizes
    from athenaeum.plans.analytics import e7_gap_score_project
    from athenaeum.sources.tables import Tables

    data = [(i % 9 or None, i % 4, ("method", "background", None, "odd")[i * i % 5 % 4]) for i in range(60)]
    edges = spark.createDataFrame(data, "citing int, cited int, intent string")
    quality = spark.createDataFrame([(1, 5), (1, 2), (2, None), (3, 1)], "citing int, quality int")
    joined = edges.join(quality, "citing", "left")
    for unknown in (1.0, None):
        weight = scoring.intent_weight(F.col("intent"), unknown)
        want = joined.groupBy("cited").agg(F.countDistinct("citing").alias("n"), F.avg(F.coalesce("quality", F.lit(3)).cast("double")).alias("q"), F.coalesce(F.avg(weight), F.lit(1.0)).alias("w"))
        got = scoring.gap_scores(edges, quality, unknown=unknown).select("cited", "citing_works", "mean_quality", "mean_weight")
        assert rows(got) == [pytest.approx(x) for x in rows(want)]
    monkeypatch.setattr(sizes, "HELD", 1000)
    plan = e7_gap_score_project(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression [citing" in line and line.rstrip().endswith(", 6"))
    deep = lambda line: len(line) - len(line.lstrip(" :+-|"))
    below = [line for line in plan[at + 1 : at + 1 + next((k for k, x in enumerate(plan[at + 1 :]) if deep(x) <= deep(plan[at])), len(plan))]]
    assert below and not [x for x in below if "Join" in x or "Aggregate" in x]
