import random
import re
from collections import Counter

from athenaeum.llm import quality


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(3)
    words = ["a", "the", "élan", "𝒳y", "x|y", "#1", "one", "two", "三"]
    made = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)]
    made += [" ".join(rng.choices(words[:2], k=40)) for _ in range(30)]  # many repeated windows
    made += ["\n".join(rng.choices(["same line here", " ", "other", "\t"], k=9)) for _ in range(20)]
    return made + [None, "", " \n\t", "w " * 8, "w " * 9, "a b c d e f g h " * 3, "x " * 30_000, "\x0b\x0ca\x1fb c"]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts())], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts()):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.base_failed and r.kept)


CLEAN = " ".join(f"word{i}x" for i in range(40))
MILD = "\n".join(["alpha beta gamma delta eps zeta"] * 2 + [f"l{i} m{i} n{i} o{i}" for i in range(3)] + ["q r"] * 3)


def test_hosts_decide_on_mild_failures(spark):
    rows = [(i, CLEAN, "good") for i in range(200)] + [(300, MILD, "good")]
    rows += [(i, "bad", "poor") for i in range(400, 600)] + [(700, MILD, "poor"), (701, CLEAN, "poor"), (702, CLEAN, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[300].mild and got[700].mild and not got[700].base_failed
    assert got[300].kept and not got[700].kept and got[701].kept and got[702].kept and got[0].kept
    assert got[300].host_rate < 0.1 < 0.9 < got[700].host_rate


def test_shrinkage(spark):
    """A host with one failing document is pulled towards the others; one with many keeps its own rate."""
    rows = [(i, CLEAN if i % 10 else "x", f"h{i % 40}") for i in range(4000)] + [(9000, "x", "new")]
    got = {r.host: r.host_rate for r in quality.host_rates(quality.rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert 0.0 < got["h1"] < 0.05 and got["h0"] > 0.9 and 0.1 < got["new"] < 1.0


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    docs = spark.createDataFrame([(1, CLEAN, "s", 5), (1, CLEAN, "s", 5), (None, CLEAN, None, 5)], "doc_id long, text string, source string, n_words int")
    assert quality.judge(docs).filter("kept").count() == 3


def test_hosts_decide_at_ordinary_rates(spark):
    """A host that fails three times as often as the corpus loses its mild failures; one a little above it doesn't, nor does a small one."""
    rates = {"even": (1000, 100), "third": (400, 120), "close": (1000, 112), "small": (4, 1)}
    rows = [(1000 * k + i, "x" if i < bad else CLEAN, host) for k, (host, (n, bad)) in enumerate(rates.items()) for i in range(n)]
    rows += [(9000 + k, MILD, host) for k, host in enumerate(rates)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [got[9000 + k].kept for k in range(4)] == [True, False, True, True]
    assert all(got[9000 + k].mild for k in range(4)) and got[9001].host_rate < 0.35


def test_keep_with_columns_of_any_name(spark):
    names = ("n_words", "host", "m", "severe", "mild", "host_rate", "rated", "kept", "row", "key", "distrusted", "base_failed", "w", "l")
    rows = [(1, CLEAN, "s"), (1, CLEAN, "s"), (None, CLEAN, None), (2, None, "s"), (3, "", "s"), (4, CLEAN + " long" * 200_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *(f"concat('{c}', source) AS {c}" for c in names))
    got = quality.keep(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got.collect()) == [(0, None, None), (1, "n_wordss", "kepts"), (1, "n_wordss", "kepts")]
