import numpy as np
import pytest
from pyspark.sql import functions as F

from athenaeum import plugs
from athenaeum.functions import arrow
from athenaeum.operators import scoring, vectors
from athenaeum.operators.sizes import bounded


def made(spark, n=150, dim=8):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((n, dim))
    v[5], v[7] = v[3], 0.0
    rows = [(i, i % 4, v[i].tolist()) for i in range(n)] + [(n, 1, [1.0, 2.0]), (n + 1, 2, None)]
    unit = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), where=np.linalg.norm(v, axis=1, keepdims=True) > 0, out=np.zeros_like(v))
    unit = np.vstack([unit, np.zeros((2, dim))])
    return spark.createDataFrame(rows, "id long, section int, v array<float>"), unit @ unit.T


def test_all_pairs_equal_brute_force(spark):
    df, s = made(spark)
    section = [i % 4 for i in range(150)] + [1, 2]
    want = {(a, b) for a in range(152) for b in range(a + 1, 152) if section[a] != section[b] and s[a, b] >= 0.5}
    for size in (1000, 40, 7):
        got = vectors.all_similar_pairs(df, 0.5, 8, size).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        assert all(r.similarity == pytest.approx(s[r.a, r.b], abs=1e-6) for r in got)
    assert vectors.all_similar_pairs(df.limit(0), 0.5, 8).count() == 0


def test_nearest_equals_brute_force(spark):
    df, s = made(spark)
    queries = df.filter("id % 10 = 3").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    for size in (1000, 16):
        got = {}
        for r in vectors.nearest(queries, df, 5, 8, size=size).collect():
            got.setdefault(r.query_id, {})[r.place] = r.id
        for q, places in got.items():
            best = sorted((i for i in range(152) if i != q), key=lambda i: (-round(s[q, i], 6), i))[:5]
            assert [round(s[q, places[k]], 5) for k in range(1, 6)] == [round(s[q, i], 5) for i in best]
        assert len(got) == 15
    assert vectors.nearest(queries.limit(0), df, 5, 8).count() == 0


def test_signatures_at_the_registered_threshold(spark):
    """Recall of the signature form against the exact one, at 0.4 as it is registered."""
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("section"), F.col("embedding").alias("v"))
    want = {(r.a, r.b) for r in vectors.all_similar_pairs(t, 0.4, 64).collect()}
    got = {(r.a, r.b) for r in vectors.similar_pairs(t, 0.4, 64, tables=24, bits=4).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 0


def test_table_function(spark):
    df, s = made(spark)
    vectors.register_nearest(spark)
    q = df.filter("id = 3").first()["v"]
    got = spark.sql("SELECT * FROM knn(TABLE({rows}) PARTITION BY section, q => :q, k => 2)", args={"q": q}, rows=df.filter("v is not null")).collect()
    for section in range(4):
        best = sorted((i for i in range(section, 150, 4)), key=lambda i: -s[3, i])[:2]
        assert [r.id for r in sorted(got, key=lambda r: r.place) if r.section == section] == best


def test_packed_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, []), (3, None)], "id long, v array<float>")
    blobs = {r.id: r.b for r in df.select("id", arrow.pack_udf("v").alias("b")).collect()}
    assert bytes(blobs[1]) == np.array([0.5, -2.0], dtype="<f4").tobytes() and bytes(blobs[2]) == b"" and blobs[3] is None
    back = {r.id: r.v for r in df.select("id", arrow.unpack_udf(arrow.pack_udf("v")).alias("v")).collect()}
    assert back == {1: [0.5, -2.0], 2: [], 3: None}


def test_semantic_factor(spark):
    """A mean of cosines with the nearest section; neutral for fewer than two vectors, and without centroids."""
    edges = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", 3), ("c", 4), ("d", 9)], "cited string, citing long")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [-1.0, 0.0]), (4, [-2.0, 0.0]), (9, [1.0])], "id long, v array<double>")
    centroids = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 1.0]), ("z", [1.0])], "target string, centroid array<double>")
    got = {r.cited: r.factor for r in scoring.semantic_factor(edges, v, centroids, 2).collect()}
    assert got == {"a": pytest.approx(0.5 + 0.5 / 2**0.5), "c": 0.5}
    assert scoring.semantic_factor(edges, v, centroids.limit(0), 2).count() == 0


def test_factor_lies_between_a_half_and_one(spark):
    rng = np.random.default_rng(42)
    edges = spark.createDataFrame([(int(c), i) for c in range(6) for i in range(c, c + 5)], "cited long, citing long")
    v = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(12)], "id long, v array<double>")
    centroids = spark.createDataFrame([(k, rng.standard_normal(8).tolist()) for k in range(3)], "target long, centroid array<double>")
    got = [r.factor for r in scoring.semantic_factor(edges, v, centroids, 8).collect()]
    assert len(got) == 6 and all(0.5 <= x <= 1 for x in got)


def test_top_intent(spark):
    edges = spark.createDataFrame([(1, "background"), (1, "background"), (1, "method"), (2, "uses_data"), (2, "method"), (3, None), (3, "odd")], "cited long, intent string")
    assert dict(scoring.top_intent(edges).collect()) == {1: "background", 2: "method"}


def test_plugs(spark):
    texts = spark.createDataFrame([(1, "one two"), (2, " "), (3, None), (4, "one two"), (5, "w " * 9000)], "id long, t string")
    got = {r.id: r.v for r in texts.select("id", plugs.embedded("t", plugs.HashingEmbedder).alias("v")).collect()}
    assert got[2] is got[3] is None and got[1] == got[4] and sum(x * x for x in got[1]) == pytest.approx(1)
    parts = sorted(map(tuple, plugs.mapped(texts, "id", "t", plugs.CountingGenerator, least=2000).filter("id = 5").select("start", "end", "status").collect()))
    assert [p[:2] for p in parts] == [(0, 4500), (4500, 9000), (9000, 13500), (13500, 18000)] and {p[2] for p in parts} == {"ok"}

    class Failing:
        def embed(self, texts):
            raise RuntimeError("no")

        def answer(self, text):
            return ("no object", False) if len(text) < 5 else ("{}", True)

    assert texts.select(plugs.embedded("t", Failing).alias("v")).filter("v is not null").count() == 0
    status = {(r.id, r.status) for r in plugs.mapped(texts.filter("id in (1, 2, 3)"), "id", "t", Failing).collect()}
    assert status == {(1, "truncated"), (2, "unreadable")}


def test_broadcasts_are_checked(spark):
    assert "broadcast" in bounded(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in bounded(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_pairs_by_pivots_are_all_pairs_at_less_work(spark):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((20, 16)) * 3
    v = middles[rng.integers(0, 20, 600)] + rng.standard_normal((600, 16)) * 0.6
    rows = [(i, i % 5, [float(x) for x in r]) for i, r in enumerate(v)] + [(600, 0, [0.0] * 16), (601, 1, [1.0]), (602, 2, None), (603, 3, []), (604, 9, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "id long, section int, v array<float>")
    unit = np.vstack([v, v[:1]]).astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    s, section = unit @ unit.T, np.array([*(i % 5 for i in range(600)), 9])
    ids = np.array([*range(600), 604])
    for threshold, n, size in ((0.9, 24, 512), (0.75, 8, 40), (0.2, 1, 100)):
        want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero((s >= threshold) & (section[:, None] != section[None, :]))) if i < j}
        got = vectors.pairs_by_pivots(df, threshold, 16, n=n, size=size).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and abs(sum(r.similarity for r in got) - sum(s[i if i < 600 else 600, j if j < 600 else 600] for i, j in want)) < 1e-6 * len(want)
    cells = vectors.Cells(df, 0.9, 16, 24)
    assert cells.compared() < 0.25 * 601 * 601 / 2 and cells.held.sum() == 601
    assert vectors.pairs_by_pivots(df.limit(0), 0.9, 16).count() == 0


def test_candidates_never_leave_a_task(spark):
    """Rows are sent to as many tasks as there are groups, a fixed number until groups are full; no candidates are joined or made distinct."""
    df, s = made(spark, n=300)
    nulls = spark.createDataFrame([(900, None, [1.0] * 8), (None, 2, [1.0] * 8)], "id long, section int, v array<float>")
    forms = {
        "all": vectors.all_similar_pairs(df.union(nulls), 0.5, 8, 10), "pivots": vectors.pairs_by_pivots(df.union(nulls), 0.5, 8, size=10),
        "signatures": vectors.similar_pairs(df.union(nulls), 0.5, 8, tables=24, bits=4, size=10),
    }
    found = {k: [(r.a, r.b) for r in x.collect()] for k, x in forms.items()}
    assert set(found["all"]) == set(found["pivots"]) > set() and set(found["signatures"]) <= set(found["all"])
    assert len(found["signatures"]) >= 0.9 * len(found["all"]) and all(len(x) == len(set(x)) for x in found.values())
    for x in forms.values():
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    assert [vectors._groups(n, 512) for n in (0, 2_048, 30_000, 60_000, 1_000_000, 2_000_000)] == [1, 1, 15, 16, 16, 31]
