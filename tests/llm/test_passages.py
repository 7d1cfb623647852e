import hashlib
import random
import re

import numpy as np

from athenaeum.llm import passages

VOCABULARY = ["a", "b", "an", "the", "long", "été", "Zug", "x9", "supercalifragilistic"]


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items):
    """doc_id, n_words, n_hit, n_items, digest of the items, straight from the rules."""
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids - {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def made(rng, items, n):
    docs = []
    for i in range(n):
        t = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 60))]
        if items and rng.random() < 0.7:
            k = rng.randint(0, len(t))
            t[k:k] = (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice(["", "-", "x "]) + rng.choice([" ", "--", "\n. "]).join(t).upper() * (i % 3 == 0) + " ".join(t) * (i % 3 > 0)))
    return docs


def test_search_equals_brute_force_at_any_cut(monkeypatch):
    """Occurrences in texts side by side and in long ones read by pieces, with cursors of any length."""
    rng = random.Random(1)
    for trial in range(120):
        items = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 15][trial % 2 * 2 :]))) for _ in range(rng.randint(1, 6))]
        patterns = sorted({b" ".join(words(i)[k : k + 10]) for i in items for k in range(max(1, len(words(i)) - 9))})
        searcher = passages.Searcher(patterns, [len(p.split()) for p in patterns], [["x"]] * len(patterns))
        docs = ["", "--", *(t for _, t in made(rng, list(enumerate(items)), 5))]
        monkeypatch.setattr(passages, "LANE", rng.choice([3, 17, 4096]))
        monkeypatch.setattr(passages, "PIECE", rng.choice([5, 40, 8 << 20]))
        raw, ends = np.frombuffer("".join(docs).encode(), dtype=np.uint8), np.cumsum([len(d.encode()) for d in docs])
        side_by_side = passages._found(searcher, passages.tidied(raw, ends))
        for row, doc in enumerate(docs):
            w = words(doc)
            want = {(k, k + len(p.split()), n) for n, p in enumerate(patterns) for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
            of = [side_by_side] if not doc else [side_by_side, passages._found_in_long(searcher, np.frombuffer(doc.encode(), dtype=np.uint8))]
            for found in of:
                at = row if found is side_by_side else 0
                assert found.n_words[at] == len(w)
                assert {(a, b, n) for r, a, b, n in zip(found.row, found.first, found.last, found.pattern) if r == at} == want


def run(spark, docs, items, ids="long"):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *(f"1 AS {c}" for c in ("key", "n_words", "spans", "items", "item_id")))
    found = passages.find(d, spark.createDataFrame(items, f"item_id {ids}, text string").selectExpr("*", "2 AS words", "3 AS pattern"))
    return sorted((tuple(r) for r in passages.contaminated(found).collect()), key=repr)


def test_query_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i // 2 if i % 5 else None, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([1, 4, 9, 10, 12, 30])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "-- !"), (93, items[0][1]), (93, items[0][1])]
    docs = [*made(rng, items[:12], 60), (7, None), (None, "the long"), (8, ""), (8, "same"), (8, "same"), (9, "x " * 300_000 + items[3][1])]
    assert run(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(passages, "BLOCK_BYTES", 300)  # many blocks, what is found travels on
    monkeypatch.setattr(passages, "PIECE", 100_000)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables_and_item_names(spark):
    docs = [(1, "one two three four five six seven eight nine ten eleven")]
    none = hashlib.sha256(b"").hexdigest()
    assert run(spark, docs, []) == [(1, 11, 0, 0, none, False)] and run(spark, [], [(1, "one")]) == []
    got = run(spark, docs, [("b", "Two THREE"), ("a,", "ten eleven"), (None, "one"), ("c", "one two three")], "string")
    assert got == [(1, 11, 5, 3, hashlib.sha256(b"a,,b,c").hexdigest(), True)]


def test_spans_are_whole_words(spark):
    d = spark.createDataFrame([(1, "other mother other's brother")], "doc_id long, text string")
    r = passages.find(d, spark.createDataFrame([(5, "other"), (6, "s brother")], "item_id long, text string")).first()
    assert (r.n_words, [tuple(s) for s in r.spans], r["items"]) == (5, [(0, 1), (2, 5)], ["5", "6"])


def test_a_long_text_takes_bounded_memory():
    """A text of 60 MB is read by pieces: what is held beside it grows with its occurrences only."""
    import tracemalloc

    searcher = passages.Searcher([b"one two three"], [3], [["x"]])
    raw = np.frombuffer(b"some words to pass over, " * 2_400_000 + b"one two  three.", dtype=np.uint8)
    tracemalloc.start()
    found = passages._found_in_long(searcher, raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.n_words[0] == 5 * 2_400_000 + 3 and found.first.tolist() == [12_000_000] and peak < 250e6
