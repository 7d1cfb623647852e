import random

import xxhash
from pyspark.sql import functions as F

from athenaeum.llm import simhash
from athenaeum.llm.components import components


def brute_print(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    up = list(range(len(values)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_fingerprints():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 7, 200):
        text = " \t".join(rng.choices(["Ab", "É", "c", "dd", "漢"], k=n))
        assert simhash.fingerprint(text) == brute_print(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a  B\nc") == simhash.fingerprint("A b C")


def near(rng, base, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        base ^= 1 << b
    return base


def test_bk_tree_finds_all_within():
    rng = random.Random(2)
    values = [near(rng, c, 6) for c in [rng.getrandbits(64) for _ in range(10)] for _ in range(30)]
    tree = simhash.BKTree()
    for v in values:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(tree.values) if (v ^ w).bit_count() <= 3]
        tree.add(v)


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(25)]
    values = sorted({near(rng, c, 5) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(100)} | {0, 7, 2**64 - 1})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = brute_components(values)
    for split in (1, 8, 100_000):
        monkeypatch.setattr(simhash, "SPLIT", split)
        got = {r.fp & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.groups(df).collect()}
        mine = [got.get(v, v) for v in values]
        assert len(set(mine)) == len(set(want))
        assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(0, len(values), 7) for j in range(len(values)))


def test_documents(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text), (4, text), (4, text), (7, text + " tail"), (None, "alone here now"), (1, None), (2, ""), (3, " "), (12, "quite other words stand in this one")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 9 and all(len(g[1]) == 16 for g in got)
    comp = {g[0]: g[2] for g in got}
    assert comp[9] == comp[4] == 4 and comp[1] == comp[2] == comp[3] == 1 and comp[None] is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == sorted({c if c is not None else -1 for c in comp.values()})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    star = spark.range(1001, 1100).select(F.col("id").alias("a"), F.lit(1000).cast("long").alias("b"))
    got = {r.node: r.root for r in components(chain.union(star)).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 1000 for i in range(1000, 1100)}
    assert components(chain.limit(0)).count() == 0


def test_one_of_each_with_columns_of_any_name_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "b"), (5, text, "a"), (5, text, "c"), (7, text + " more", "a"), (None, "quite other", "z"), (None, "quite other", "y"), (2, None, "n"), (8, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ("_id", "_hash", "_row", "_rank", "_text", "key", "root", "n", "bands", "k", "fp")
    odd = docs.selectExpr("*", *(f"concat('{c}', lang) AS {c}" for c in names))
    for n in (1, 4):
        got = simhash.one_of_each(odd.repartition(n))
        assert got.columns == odd.columns
        assert sorted((r.doc_id or 0, r.lang, r._id, r.key) for r in got.collect()) == [(0, "y", "_idy", "keyy"), (2, "n", "_idn", "keyn"), (5, "a", "_ida", "keya")]


def test_one_very_long_text(spark):
    long = " ".join(f"v{i % 5000}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {1, 3}
