import random

from athenaeum.llm import preference


def made(spark, turns):
    g = preference.gather(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    return {(r.chosen_id, r.rejected_id): r for r in preference.format_pairs(g, preference.pair_by_number(g)).collect()}


def test_common_prefix_and_masks(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "a long answer")]
    turns += [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "short")]
    r = made(spark, turns)[(0, 1)]
    assert r.n_common == 3
    assert r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n"
    assert r.chosen == "<|assistant|>\na long answer<|end|>\n" and r.rejected == "<|assistant|>\nshort<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["a long answer<|end|>\n"]


def test_edges(spark):
    turns = [(2, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, None), (5, 0, "user", "z"), (5, 0, "user", "z"), (6, 1, "assistant", "alone"), (None, 0, "user", "q")]
    got = made(spark, turns)
    alike = got[(2, 3)]
    assert (alike.n_common, alike.chosen, alike.rejected, alike.chosen_spans) == (1, "", "", [])
    assert got[(4, 5)].n_common == 0 and got[(4, 5)].prompt == "" and got[(4, 5)].rejected.count("<|end|>") == 2
    assert len(got) == 2 and made(spark, turns[:0]) == {}


def plain(turns, block):
    """Pairs and their parts straight from the rules."""
    talks = {}
    for c, t, role, text in turns:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    talks = {c: [x[2:] for x in sorted(v)] for c, v in talks.items()}
    groups, left, pairs = {}, {}, []
    for c in sorted(talks):
        groups.setdefault((talks[c][0], c // block), []).append(c)
    for members in groups.values():
        even = len(members) // 2 * 2
        pairs += [members[i : i + 2] for i in range(0, even, 2)]
        for c in members[even:]:
            left.setdefault(c // 2, []).append(c)
    pairs += [x for x in left.values() if len(x) == 2]
    answers = lambda c: sum(len(t) for r, t in talks[c] if r == "assistant")
    out = {}
    for a, b in pairs:
        best, worst = sorted((a, b), key=lambda c: (-answers(c), c))
        x, y = talks[best], talks[worst]
        n = next((i for i in range(max(len(x), len(y))) if x[i : i + 1] != y[i : i + 1]), len(x))
        show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
        out[best, worst] = (n, show(x[:n]), show(x[n:]), show(y[n:]))
    return out


def test_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    turns = []
    for c in range(300):
        n = rng.randint(1, 5)
        turns += [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "yes", None, "a longer answer"])) for i in range(n)]
    turns += [(400, 0, "user", "long " * 100_000), (401, 0, "user", "long " * 100_000), (401, 1, "assistant", "end")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *(f"1 AS {c}" for c in ("pair", "n", "opening", "block", "turns", "t", "place", "chosen_id")))
    for block in (128, 8):
        monkeypatch.setattr(preference, "BLOCK", block)
        g = preference.gather(df)
        got = preference.format_pairs(g, preference.pair_by_opening(g)).collect()
        want = plain(turns, block)
        assert {(r.chosen_id, r.rejected_id): (r.n_common, r.prompt, r.chosen, r.rejected) for r in got} == want and len(got) == len(want)
        assert sum(r.n_common > 0 for r in got) > 50
        for r in got:
            for made, spans in ((r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)):
                assert all(made[x.start : x.end].endswith("<|end|>\n") and made[: x.start].endswith("<|assistant|>\n") for x in spans)
