import random

import numpy as np
from pyspark.sql import functions as F

from athenaeum.llm import shingles, simhash
from athenaeum.llm.common import documents


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(sets):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(i, j) for ids in holders.values() for j in ids for i in ids if i < j}
    pairs = [(i, j) for i, j in met if similar(sets[i], sets[j])]
    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return pairs, [root(i) for i in range(len(sets))]


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    """Copies changed in some words, and chains of them, on both sides of the similarity; far too different for three bits."""
    rng = random.Random(4)
    texts = []
    for k in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((60, 150, 400)))]
        for _ in range(4):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 22))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
    order = list(range(len(texts)))
    pairs, root = brute_groups([brute_sets(t) for t in texts])
    apart = [p for p in pairs if (simhash.fingerprint(texts[p[0]]) ^ simhash.fingerprint(texts[p[1]])).bit_count() > 3]
    assert len(apart) > 20 and len(set(root)) > 45
    rng.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))


def test_no_similar_pair_stays(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    kept = [brute_sets(r.text) for r in simhash.one_of_each(docs).collect()]
    few = {}
    for i, s in enumerate(kept):
        for x in s:
            few.setdefault(x, []).append(i)
    pairs = {(i, j) for ids in few.values() if len(ids) <= 40 for i in ids for j in ids if i < j}
    assert not [p for p in pairs if similar(kept[p[0]], kept[p[1]])]


def test_a_large_group_meets_in_blocks(spark, monkeypatch):
    """Variants of one text, some of each two similar enough and some not, in buckets of many blocks."""
    rng = random.Random(8)
    base, texts = [f"w{i}" for i in range(80)], []
    for _ in range(70):
        words = list(base)
        for k in rng.sample(range(80), rng.choice((1, 2, 2, 3))):
            words[k] = f"x{rng.randrange(99999)}"
        texts.append(" ".join(words))
    pairs, root = brute_groups([brute_sets(t) for t in texts])
    assert 3 < len(set(root)) < 60 and len(pairs) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for members in (shingles.MEMBERS, 5):
        monkeypatch.setattr(shingles, "MEMBERS", members)
        assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(root))


def test_intersections(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [[np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)] for n in (7, 11)]
    want = [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
    for cells in (1, 30, 1 << 20):
        monkeypatch.setattr(shingles, "CELLS", cells)
        got = shingles.intersections([np.concatenate(s) for s in sets], [np.array([len(x) for x in s]) for s in sets])
        assert got.tolist() == want


def test_fingerprints_bring_texts_together(spark, monkeypatch):
    """With no minima to meet by, texts meet by their fingerprints through the trees, and stay apart where these differ in more bits or the texts do."""
    rng = random.Random(6)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for _ in range(4):
            texts.append(" ".join(words))
            words = [*words[: -rng.choice((1, 1, 2, 9, 40))], f"x{rng.randrange(9999)}"]
    sets = [brute_sets(t) for t in texts]
    prints = [shingles.voted(shingles.shingles(t)[1]) for t in texts]
    near = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS}

    def closed(pairs):
        least = list(range(len(texts)))
        for _ in texts:
            for i, j in pairs:
                least[i] = least[j] = min(least[i], least[j])
        return least

    bucket = closed(near)
    want = closed([(i, j) for j in range(len(texts)) for i in range(j) if bucket[i] == bucket[j] and similar(sets[i], sets[j])])
    everywhere = closed([(i, j) for j in range(len(texts)) for i in range(j) if similar(sets[i], sets[j])])
    assert len(near) > 10 and len(texts) > len(set(want)) > len(set(everywhere))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(everywhere)
    made = shingles.sketches
    monkeypatch.setattr(shingles, "sketches", lambda docs: made(docs).withColumn("bands", F.expr("cast(array() AS array<bigint>)")))
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(want)
