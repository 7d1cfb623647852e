import random
import re

import pytest
from pyspark.sql import functions as F

from athenaeum.llm import mixing


def brute_targets(sizes):
    """Fill again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def corpus(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "é", "Z", None, "tiny"])
        size = rng.choice([0, 1, 7, 7, 50, rng.randint(1, 400)])
        out.append((i, " ".join(["w"] * size) if size or rng.random() < 0.5 else None, source))
    return out


def test_size(spark):
    texts = ["", None, " ", "a", " a  b\n", "w" * 50, "é 漢\tw", "a\x1fb", "\x0ba\x0c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.size_of(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    got = mixing.mix(docs).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert len(got) == len(rows) and {r.doc_id: r.taken for r in got} == again
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size) and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 20), (s, t, taken[s])


def test_rates_meet_targets(spark):
    """Before rounding, expected words equal the targets: the dual is solved."""
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string, source string")
    r = mixing.mix(docs).groupBy("target").agg(F.sum(F.col("rate") * F.col("size")).alias("x")).collect()
    assert all(x.x == pytest.approx(x.target, rel=1e-6) for x in r)


def test_hot_cell(spark, monkeypatch):
    """Many documents of one source and size are dealt into parts and still come out right."""
    monkeypatch.setattr(mixing, "CELL", 16)
    docs = spark.createDataFrame([(i, "w w w w w", "hot") for i in range(900)] + [(i, "w w", "b") for i in range(900, 1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).join(docs, "doc_id").groupBy("source").agg(F.sum("taken").alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) <= 10 for r in got)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    zero = spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(zero).collect()] == [0, 0, 0] and mixing.mixed(zero).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s", "x"), (1, "a b", "s", "x"), (2, "c", "s", "y"), (None, "d e f", None, "z")], "doc_id long, text string, source string, extra string")
    m = mixing.mix(twice)
    assert mixing.mixed(twice).count() == m.agg(F.sum("copies")).first()[0] and mixing.mixed(twice).columns == twice.columns


NAMES = ("_id", "_hash", "_source", "_copies", "_copy", "_row", "_rank", "size", "mark", "copies", "taken", "rate", "part", "nth", "target", "source_size")


def test_columns_of_any_name_and_ties(spark):
    """Names that are used inside pass through; of rows alike in id, text and source always the same one stays."""
    rows = [(i % 40, "w " * (i % 7 + 1), "ab"[i % 2], f"lang{i % 3}", {"k": i % 5}) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, m map<string,int>")
    odd = docs.selectExpr("*", *(f"concat('{c}', lang) AS {c}" for c in NAMES))
    seen = []
    for n in (1, 5):
        got = mixing.mixed(odd.repartition(n))
        assert got.columns == odd.columns
        seen.append(sorted(str(r) for r in got.collect()))
    assert seen[0] == seen[1] and seen[0]
    assert all(f"_copies='_copies{r.split(chr(39))[5]}'" in r for r in seen[0])
    assert mixing.mix(odd).count() == len(rows)


def test_one_very_long_text_and_null_ids(spark):
    docs = spark.createDataFrame([(None, f"a b {i}", "s") for i in range(3000)] + [(1, "long " * 400_000, "t"), (2, "x", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 3002 and max(r.size for r in got) == 400_000
    s = sum(r.taken for r in got if r.size == 3)
    assert abs(s - next(r.target for r in got if r.size == 3)) <= 3
