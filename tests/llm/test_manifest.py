import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from athenaeum.llm import manifest

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def brute_tree(nodes):
    """The root, and for each leaf what stands left and right of its path."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level, at = [h("".join(level[k : k + 8])) for k in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0] if level else None, paths


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        members = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (members, *brute_tree([leaf(r) for r in members]))
    root, upper = brute_tree([trees[x][1] for x in order])
    out = []
    for lang, up in zip(order, upper):
        members, subroot, paths = trees[lang]
        for r, path in zip(members, paths):
            path = path + up
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                node = h(left + node + right)
            out.append((r[0], leaf(r), subroot, root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", *(f"1 AS {c}" for c in ("tree", "leaf", "node", "rank", "block", "part", "at", "height", "path", "top", "changed")))
    return sorted((tuple(r) for r in manifest.verified(manifest.manifest(docs.repartition(5))).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(8, 1, 65), (0, 512, 513)])
def test_trees_equal_brute_force(spark, sizes):
    rng = random.Random(str(sizes))
    rows = [(rng.randint(-50, 10**12), rng.choice(["s", None]), [None, "en", "é"][k], i, rng.choice(["Text", "text", None, "", "Ünï"])) for k, n in enumerate(sizes) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_many_languages_and_small_blocks(spark, monkeypatch):
    """Rounds of one level each, and a tree of languages of its own height."""
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    rows = [(i, "s", f"l{i % 70}", i, "A" * (i % 3)) for i in range(80)] + [(i, "s", "big", i, "b") for i in range(70)]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None,) * 5, (None, None, None, None, "X"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "Y"), (3, "-", "", 0, ""), (4, "1:-", "en", 10**7, "Long " * 2_000_000)]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == len(rows)
    assert run(spark, []) == []


def test_tampering_is_found(spark):
    got = run(spark, [(i, "s", "en", 4, "Text" if i % 2 else "text") for i in range(100)])
    assert {r[0] for r in got if not r[6]} == {i for i in range(1, 100, 2) if zlib.crc32(str(i).encode()) % 3 == 0}


def test_fold_names_the_root(spark):
    rows = manifest.manifest(spark.createDataFrame([(i, None, "en", i, "t") for i in range(20)], FIELDS))
    assert rows.filter(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
