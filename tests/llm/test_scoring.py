import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from athenaeum.llm import ngrams, toxicity


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def brute_spelled(types, order, word):
    """Interpolated Witten-Bell over byte n-grams, straight from the counts."""
    levels = [Counter() for _ in range(order)]
    for w, k in types.items():
        s = b" " * (order - 1) + w + b" "
        for j in range(order - 1, len(s)):
            for o in range(order):
                levels[o][s[j - o : j + 1]] += k

    def p(gram):
        lower = p(gram[1:]) if len(gram) > 1 else 1 / 256
        followers = [n for g, n in levels[len(gram) - 1].items() if g[:-1] == gram[:-1]]
        if not followers:
            return lower
        return (levels[len(gram) - 1][gram] + len(followers) * lower) / (sum(followers) + len(followers))

    s = b" " * (order - 1) + word + b" "
    return sum(math.log10(p(s[j - order + 1 : j + 1])) for j in range(order - 1, len(s)))


def brute_automaton(rows, held, size):
    """Backoff word model by plain counting: a function of a text, its base score, and how many of its tokens are known."""
    grams, states, types, n_docs = [Counter() for _ in range(ngrams.GRAMS)], Counter(), Counter(), 0
    for i, t, *_ in rows:
        if held[i]:
            continue
        n_docs += 1
        seq = ["<s>", *tokens(t), "</s>"]
        for text, lead, last in ngrams.cut_text((t or "").encode(), size):
            types.update({*tokens(text.decode())[lead:], *([b""] if last else [])} | set(tokens(text.decode())[:lead]) | {b""})
        for j in range(1, len(seq)):
            for n in range(ngrams.GRAMS):
                if j - n >= 0:
                    grams[n][tuple(seq[j - n : j + 1])] += 1
                    states[tuple(seq[j - n : j])] += 1
    total, kinds, spelled = states[()], len(grams[0]), {}

    def logp(w, context):
        n = states[context]
        word = b"" if w == "</s>" else w
        if word not in spelled:
            spelled[word] = brute_spelled(types, ngrams.ORDER, word)
        # fractions keep what underflows as a float
        lower = logp(w, context[1:]) if context else spelled[word]
        if not n:
            return lower
        theta = n**ngrams.HEAPS
        c = grams[len(context)][(*context, w)]
        back = math.log10(theta / (n + theta)) + lower
        return math.log10(c / (n + theta) + 10**back) if c else back

    def of(t):
        seq = ["<s>", *tokens(t), "</s>"]
        score = sum(logp(seq[j], tuple(seq[max(0, j - ngrams.GRAMS + 1) : j])) for j in range(1, len(seq)))
        base = sum(math.log10((grams[0][(w,)] + 0.1) / (total + 0.1 * (kinds + 1))) for w in seq[1:])
        return score, base, len(seq) - 1, sum(grams[0][(w,)] > 0 for w in seq[1:])

    return of, total


def test_scores_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "The", "thing", "sing", "élan", "x", "of", "|", "a\u00a0b"]
    rows = [(i, " ".join(rng.choices(words + [f"n{rng.randint(0, 30)}"], k=rng.randint(0, 25)))) for i in range(90)]
    rows += [(100, None), (101, ""), (102, "z" * 1500), (103, "the"), (103, "the"), (104, "only once said"), (None, " \t\n"), (105, rows[3][1])]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    assert any(held.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # an extra column of every name that is used inside
    odd = docs.selectExpr("*", *(f"1 AS {c}" for c in ("block", "bucket", "held_out", "n", "keys", "counts", "totals", "kinds", "raw", "score", "new", "lang", "n_tokens")))
    for size in (ngrams.BLOCK_BYTES, 200, 12):
        of, total = brute_automaton(rows, held, size)
        got = ngrams.score(odd, size=size).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        want = {i: of(t) for i, t in rows}
        for r in got:
            score, base, length, known = want[r.doc_id]
            assert r.held_out == held[r.doc_id] and r.train_tokens == total and (r.n_tokens, r.n_known) == (length, known)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-6)


def test_parts_of_a_text():
    """Cut anywhere, the parts' own words are the text's, and each has the two words before it."""
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choices(["a", "bc", " ", "\n ", "é", "d" * 300], weights=[5, 5, 6, 2, 2, 1], k=rng.randint(1, 60))).encode()
        words, seen = raw.split(), []
        parts = list(ngrams.cut_text(raw, rng.choice([1, 5, 40, 1000])))
        for text, lead, last in parts:
            own = text.split()
            assert own[:lead] == seen[len(seen) - lead :] and lead == min(len(seen), ngrams.GRAMS - 1)
            seen += own[lead:]
        assert seen == words and [p[2] for p in parts] == [False] * (len(parts) - 1) + [True]


def test_order_of_words_counts(spark):
    text = "one two three four five six seven eight"
    shuffled = " ".join(reversed(text.split()))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(1, text), (2, text), (held[0], text), (held[1], shuffled)]
    by = {r.doc_id: r for r in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[held[0]].score > by[held[1]].score + 3 and by[held[0]].base_score == pytest.approx(by[held[1]].base_score)
    # a text that training has twice is surer than one it has once
    twice = ngrams.score(spark.createDataFrame([(1, text), (2, text), (3, shuffled)], "doc_id long, text string"))
    at = {r.doc_id: r.score for r in twice.collect()}
    assert at[1] == at[2] > at[3]


def test_what_may_follow_adds_up_to_one():
    """The arcs of a state, with what fails to the shorter state, make up a distribution."""
    spelled = np.log10(np.array([0.25, 0.25, 0.25, 0.25]))
    # after state (u, v), seen 3 times; v seen 10 times; 40 tokens in all
    counts = [np.array([20.0, 10, 10, 0]), np.array([7.0, 3, 0, 0]), np.array([3.0, 0, 0, 0])]
    total = 0.0
    for w in range(4):
        at = [np.array([40.0, 10.0, c[w]]) for c in counts]
        at[1][1], at[2][:2] = 3.0, 0
        total += 10 ** ngrams.walk(at, np.array([0, 3]), np.array([0.0, 0.0, spelled[w]]), 40, 40)[2]
    assert total == pytest.approx(1)


def test_lm_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ngrams.score(empty).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = ngrams.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and math.isfinite(r.score) and r.base_score == pytest.approx(0)


def test_automaton_is_a_distribution():
    """What may follow any state adds up to one over all bytes."""
    ngrams_order = ngrams.ORDER
    grams = [Counter() for _ in range(ngrams_order)]
    for w in (b"abc", b"abd", b"bca", b"aab"):
        s = b" " * (ngrams_order - 1) + w + b" "
        for j in range(ngrams_order - 1, len(s)):
            for o in range(ngrams_order):
                grams[o][s[j - o : j + 1]] += 1
    a = ngrams.Automaton([dict(g) for g in grams])
    for prefix in (b"", b"a", b"ab", b"zz", b"abca"):
        texts = [prefix + bytes([b]) for b in range(256)]
        data, at = np.frombuffer(b"".join(texts), dtype=np.uint8), np.arange(257) * (len(prefix) + 1)
        start = a.score(np.frombuffer(prefix, dtype=np.uint8), np.array([0, len(prefix)]))[0] if prefix else 0.0
        assert (10 ** (a.score(data, at) - start)).sum() == pytest.approx(1)


def within(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_levenshtein_automaton():
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(2))
        for most in (0, 1, 2):
            auto = toxicity.Levenshtein(a, most)
            state = auto.start()
            for c in b:
                state = auto.step(state, c) if state else None
            assert bool(state and state[-1] <= most) == (within(a, b) <= most)


def test_lexicon_lookup_equals_brute_force():
    lexicon = toxicity.Lexicon({"idiot", "scum", "worthless", "clown"}, {"lowei", "achlich"}, exact={"clown"}, ordinary={"idiots"})
    rng = random.Random(3)
    for _ in range(6000):
        term = rng.choice(["idiot", "scum", "worthless", "clown", "loweix", "plain", "achlichkeit", "idiots"])
        w = list(term)
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o"])
            w = w or ["q"]
        word = "".join(w)
        got = lexicon.find(word)
        if word in lexicon.words:
            assert got == (word, 0, "word")
        elif word.startswith(("lowei", "achlich")):
            assert got == (word[:5] if word[0] == "l" else "achlich", 0, "stem")
        elif word == "idiots":
            assert got is None
        else:
            near = sorted(t for t in ("idiot", "worthless") if within(t, word) <= 1)
            stems = ["achlich"] if min(within("achlich", word[:n]) for n in range(len(word) + 1)) <= 1 else []
            assert got == ((near or stems)[0], 1, "word" if near else "stem") if near or stems else got is None, (word, got, near)


def test_quotation_is_told_from_abuse():
    plain = [(f"you {w} and {v} go away {i}", 1) for i, (w, v) in enumerate([("idiot", "clown"), ("clown", "scumbag"), ("scumbag", "idiot")] * 20)]
    quoted = [(f'she quoted him as saying "{w}" in the report number {i} of the press', 0) for i, w in enumerate(["idiot", "clown", "scumbag"] * 7)]
    clean = [(f"quite ordinary words number {i} of the press", 0) for i in range(120)]
    rows = plain + quoted + clean
    random.Random(1).shuffle(rows)
    model, known = toxicity.fit(rows, 60 / 201), {}
    assert model.score("you clown and idiot", known) > 0.5 > model.score('he called them "idiot" in the report', known) > model.score("nothing here", known) - 1e-9
    assert model.score("", known) < 0.3


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right >= 0.9 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "idiot")], "doc_id long, text string")
    nolabels = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(odd, nolabels).collect()] == pytest.approx([0.5] * 3)


def test_misspellings_of_words_that_a_stem_explains_are_found():
    toxic = [f"tu es {w} vraiment numero {i}" for i, w in enumerate(["minable", "minables", "minablement"] * 20)]
    lexicon = toxicity.lexicon_of(toxic, [f"une page calme numero {i}" for i in range(60)])
    assert "minable" not in lexicon.words and lexicon.find("minables")[2] == "stem"
    assert lexicon.find("monables")[1:] == (1, "word") and lexicon.find("minxables")[1] == 1


def test_features_equal_brute_force():
    lexicon = toxicity.Lexicon({"idiot", "worthless", "scum"}, {"achlich"}, ordinary={"idiots"})
    model, rng = toxicity.Model(lexicon, np.zeros(len(toxicity.FEATURES)), 0.0), random.Random(6)
    pool = ["idiot", "Idiot", "idjot", "idiots", "worthles", "worthless", "scum", "scvm", "achlichen", "achluchen", '"idiot"', "said", "the", "of", "«scum»", "plain", "word", "é", "x" * 300]
    for _ in range(400):
        text = " ".join(rng.choices(pool, k=rng.randint(0, 30)))
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text.lower())]
        kinds = []
        for w, _, _ in words:
            exact = w in lexicon.words
            stem = w.startswith("achlich")
            near = w != "idiots" and (any(within(t, w) <= 1 for t in ("idiot", "worthless")) or min(within("achlich", w[:n]) for n in range(len(w) + 1)) <= 1)
            kinds.append("exact" if exact else "stem" if stem else "misspelled" if near else None)
        want = dict.fromkeys(toxicity.FEATURES, 0.0)
        hits = [i for i, k in enumerate(kinds) if k]
        for i in hits:
            want[kinds[i]] += 1
            a, b = words[i][1:]
            marks = any(c in toxicity.QUOTES for c in text[max(0, a - 2) : a]) and any(c in toxicity.QUOTES for c in text[b : b + 2])
            around = [words[j][0] for j in range(max(0, i - 4), min(len(words), i + 5)) if j != i]
            want["quoted"] += marks or "said" in around
            want["crowded"] += any(j != i and abs(j - i) <= 4 for j in hits)
        want = {k: math.log1p(v) for k, v in want.items()} | {"density": math.log1p(1000 * len(hits) / (len(words) + 20))}
        assert model.features(text, {}) == pytest.approx([want[k] for k in toxicity.FEATURES])


def planted(rng, i, terms):
    filler = [f"{a}{b}" for a in ("ra", "lo", "mi", "tu") for b in ("na", "ver", "sol", "pim")]
    return " ".join(rng.sample([*rng.choices(filler, k=20), *terms, f"n{i}"], k=21 + len(terms)))


def test_planted_misspellings_are_caught(spark):
    """Terms that training has as they are stand misspelled in held-out rows; clean rows stay clean, and copies score alike."""
    rng = random.Random(9)
    terms = ["moronic", "imbecile", "worthless", "pathetic", "disgusting"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        held = zlib.crc32(str(i).encode()) % 4 == 2
        chosen = rng.sample(terms, 2) if toxic else []
        if held:
            chosen = [t[:k] + rng.choice(["", "z", t[k] * 2]) + t[k + 1 :] for t in chosen for k in [rng.randrange(1, len(t) - 1)]]
        rows.append((i, planted(rng, i, chosen), "x", 0.5))
        labels.append((i, int(toxic)))
    rows += [rows[2], (10_001, rows[0][1], "x", 0.5), (10_002, "clean words " * 50_000, "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.weights[toxicity.FEATURES.index("misspelled")] > 0.2
    got = toxicity.score(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[10_001].score == by[0].score and by[10_002].predicted == 0
    right = [by[i].predicted == y for i, y in labels if by[i].held_out]
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_give_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None


def test_readers_of_parts_carry_the_same_states(monkeypatch):
    """A text read by one reader and by many gives the same sums; arcs that were never put in are not found."""
    rng = np.random.default_rng(6)
    tokens = rng.choice(12, size=4000, p=np.array([1 / (i + 1) for i in range(12)]) / sum(1 / (i + 1) for i in range(12)))
    starts = np.array([0, 1, 700, 701, 2500, 4000])
    found = ngrams.levels(rng.integers(0, 2**63, 12).astype(np.uint64)[tokens], starts)
    grams, counts = [], []
    for at, h in found:
        kinds, inverse = np.unique(h, return_inverse=True)
        n = rng.integers(0, 6, len(kinds)) if len(grams) else np.full(len(kinds), 50)
        g, c = np.full(len(tokens), -1), np.zeros(len(tokens))
        g[at], c[at] = inverse, n[inverse]
        grams.append(g)
        counts.append(np.where(counts[-1] > 0, c, 0) if counts else c)
    scored = []
    for run in (10_000, 128, 3):
        monkeypatch.setattr(ngrams, "RUN", run)
        scored.append(ngrams.WordAutomaton(tokens, starts, grams, counts, np.full(12, -3.0), 600, 5).score(tokens, starts))
    assert np.allclose(scored[0], scored[1]) and np.allclose(scored[0], scored[2])
    keys = rng.choice(10**12, size=5000, replace=False)
    arcs = ngrams.Arcs(keys[:4000])
    assert (arcs.find(keys[:4000]) == np.arange(4000)).all() and (arcs.find(keys[4000:]) == -1).all()
    assert (ngrams.Arcs(keys[:0]).find(keys) == -1).all()
