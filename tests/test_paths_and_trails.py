import random

import pytest

from athenaeum.operators import graph, paths, scoring

FILES = [
    "a/exact.pdf", "b/Found by lookup.pdf", "c/My smithSea2020ice copy.PDF", "c/SMITHSEA2020ICE.pdf", "d/Ice drift of the north (2019).pdf", "d/Ice drift of the north.pdf",
    "e/Wagner et al - 2018 - Seaice models.pdf", "e/Someone - 2018 - Seaice by Wagner.pdf", "f/wagner_2018_information.pdf", "g/drifting icebergs 2019.pdf", None,
]


def test_tiers_in_order(spark):
    works = [
        (1, "smithSea2020ice", "Ice drift of the north", "a/exact.pdf", "b/Found by lookup.pdf"),
        (2, "smithSea2020ice", None, "gone.pdf", "b/Found by lookup.pdf"),
        (3, "smithSea2020ice", "Ice drift of the north", None, "gone.pdf"),
        (4, "jonesDrift2019", "The north: drift and more", None, None),
        (5, "jonesDrift2021", "The north: drift and more", None, None),
        (6, "jonesDrift", "The north: drift and more", None, None),
        (7, "wagnerSeaiceInformation2018", "", None, None),
        (8, "wagnerInformation2018", None, None, None),
        (9, "Wagner2018", "Nothing", None, None),
        (10, None, None, None, None),
        (11, "x1", "drift drift drift", None, None),
    ]
    got = {r.id: (r.tier, r.path) for r in paths.resolve(spark.createDataFrame(works, "id long, key string, title string, direct string, lookup string"), spark.createDataFrame([(f,) for f in FILES * 2], "path string")).collect()}
    assert got == {
        1: (1, "a/exact.pdf"), 2: (2, "b/Found by lookup.pdf"), 3: (3, "c/My smithSea2020ice copy.PDF"), 4: (4, "d/Ice drift of the north (2019).pdf"),
        6: (4, "d/Ice drift of the north (2019).pdf"), 7: (5, "e/Wagner et al - 2018 - Seaice models.pdf"), 8: (5, "f/wagner_2018_information.pdf"),
    }


def test_a_frequent_word_meets_little(spark):
    """All names and titles share a word: it is none of the words that works are joined by."""
    works = spark.createDataFrame([(i, f"k{1000 + i}", f"model word{i}x tail{i}x", None, None) for i in range(200)], "id long, key string, title string, direct string, lookup string")
    names = spark.createDataFrame([(f"model tail{i}x {1000 + i}.pdf",) for i in range(200)], "path string")
    got = {r.id: (r.tier, r.path) for r in paths.resolve(works, names).collect()}
    assert got == {i: (4, f"model tail{i}x {1000 + i}.pdf") for i in range(200)}


def test_what_is_made_of_names_is_never_broadcast(spark, tmp_path):
    """A plan takes runs and pairs of words for as small as the table they come from; keys that begin alike don't meet all names."""
    works = spark.createDataFrame([(i, f"authorSame{1000 + i}", None, None, None) for i in range(300)], "id long, key string, title string, direct string, lookup string")
    works.write.parquet(f"{tmp_path}/works")
    spark.createDataFrame([(f"k/x authorSame{1000 + i} y{i % 2}.pdf",) for i in range(300)], "path string").write.parquet(f"{tmp_path}/files")
    found = paths.resolve(spark.read.parquet(f"{tmp_path}/works"), spark.read.parquet(f"{tmp_path}/files"))
    assert {(r.id, r.tier, r.path) for r in found.collect()} == {(i, 3, f"k/x authorSame{1000 + i} y{i % 2}.pdf") for i in range(300)}
    lines = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastHashJoin" in line:  # the built side is the lower of the two
            children = [j for j in range(i + 1, len(lines)) if depth[j] == depth[i] + 3 and all(d > depth[i] for d in depth[i + 1 : j + 1])]
            side = children[1 if "BuildRight" in line else 0]
            below = [lines[side], *(lines[j] for j in range(side + 1, len(lines)) if all(d > depth[side] for d in depth[side + 1 : j + 1]))]
            assert not any("Generate explode" in x for x in below) or any("Aggregate" in x for x in below[:3])


def closure(links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    def reach(a):
        seen, stack = set(), [a]
        while stack:
            for b in out.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        return seen - {a}
    return {(a, b) for a in out for b in reach(a)}


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(100)], [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (1, 2), (5, 1)]])
def test_reachable(spark, links):
    got = [tuple(r) for r in graph.reachable(spark.createDataFrame(links, "a long, b long")).collect()]
    assert set(got) == closure(links) and len(got) == len(set(got))


def test_reachable_of_random_links_and_its_bound(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(70)]
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in graph.reachable(df).collect()} == closure(links)
    with pytest.raises(RuntimeError):
        graph.reachable(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), rounds=3)


def test_trail(spark):
    rows = [(1, 10, None), (2, 20, "[1, 1, 2, 77]"), (3, 15, "[2]"), (4, 5, "no list"), (5, 30, "[3, 4]")]
    got = [tuple(r) for r in graph.trail(spark.createDataFrame(rows, "id long, at long, influenced_by string")).collect()]
    assert got == [(4, 5, [], []), (1, 10, [], []), (3, 15, [2], [1, 2]), (2, 20, [1], [1]), (5, 30, [3, 4], [1, 2, 3, 4])]


def test_feedback(spark):
    rows = [(i, i // 2, '{"type": "a"}', "like" if i % 3 else "dislike") for i in range(30)] + [(100, 1, None, "like"), (101, 2, "{}", None), (102, None, "broken", "dislike")]
    got = {r.topic: r for r in scoring.feedback(spark.createDataFrame(rows, "id long, at long, context string, verdict string")).collect()}
    assert (got["a"].likes, got["a"].dislikes, [n["id"] for n in got["a"].notes]) == (20, 10, list(range(29, 19, -1)))
    assert (got["unknown"].likes, got["unknown"].dislikes, [tuple(n) for n in got["unknown"].notes]) == (1, 1, [(100, 1), (102, None)])
    plan = scoring.feedback(spark.createDataFrame(rows, "id long, at long, context string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task keeps its own last few
