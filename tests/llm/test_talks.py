import hashlib
import math
import random
import zlib

import pytest

from athenaeum.llm import ranks, talks

TURN = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node straight from the rules."""
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            said.setdefault(c, []).append((turn is not None, turn or 0, role[:64], text[:64], digest, role, text))
    said = {c: [x[5:] for x in sorted(v)] for c, v in said.items()}
    made = {}
    for c in said:
        n = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(said.get(c - int(math.fmod(c, 5)), [])[:n] + said[c][n:])
    members, children = {}, {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
            if d:
                children.setdefault(t[: d - 1], set()).add(t[:d])
    out = []
    for node, cs in members.items():
        below, stack = [], [node]
        while stack:
            x = stack.pop()
            below.append(x)
            stack += children.get(x, ())
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, ())), sum(not children.get(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, TURN).selectExpr("*", *(f"1 AS {c}" for c in ("depth", "a", "b", "x", "y", "said", "bytes", "rank", "size", "top", "saved", "n_convs")))
    return sorted((tuple(r) for r in talks.trie(df.repartition(3)).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_tries_equal_brute_force(spark, monkeypatch, small):
    if small:  # runs and blocks that most conversations cross
        monkeypatch.setattr(ranks, "RUN", 2)
        monkeypatch.setattr(talks, "IDS", 3)
    rng = random.Random(7 + small)
    rows = []
    for c in range(60):
        if c % 11 != 5:
            rows += [(c, rng.choice([i, i, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hallo", "größer", "", None])) for i in range(rng.randint(1, 12))]
    rows += [(c, i, "user", "same start") for c in range(100, 140) for i in range(4 + c % 2)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(None, 0, "user", "nobody's"), (1, 0, "user", "short"), (2, None, None, None), (2, None, None, None), (-7, 3, "user", "below zero"), (-5, 1, "user", "b"), (10**12, 0, "a" * 100, "t" * 100 + "x"), (10**12, 0, "a" * 100, "t" * 100 + "y")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_a_long_conversation_takes_few_rounds(spark, monkeypatch):
    """Twins of 300 turns and their tails: a chain reports as one, so rounds don't grow with turns."""
    rounds = []
    seen = talks.cut
    monkeypatch.setattr(talks, "cut", lambda df, name: (rounds.append(name), seen(df, name))[1])
    rows = [(5 * c, i, "user", f"turn {i}" if i < 200 else f"{c} {i}") for c in (1, 2, 3) for i in range(300)] + [(100, i, "user", "x" * i) for i in range(50)]
    got = run(spark, rows)
    want = brute(rows)
    assert got == want and rounds.count("finished") <= 4
