"""Host-level quality rules.

Every document is held against a few rules. Rule failures are counted by host (the ``source`` column, or any
expression given), the hosts' failure rates are shrunk towards the corpus by a beta prior fitted to the hosts
themselves (method of moments), and each host's verdict is joined back to its documents:

* base rules (too few words, repeated passages) and severe rules (symbols, shouting, stuttering) reject anywhere;
* mild rules (repeated lines, odd word lengths) reject only on a host that stands out: the lower bound of its failure rate,
  ``SURE`` deviations of its beta posterior below the shrunk rate, is above ``EXCESS`` times the corpus' rate.

A document without any failure is therefore kept whatever its host is. All of it is DataFrame functions; the counts are
taken inside the row, so no word leaves its document and the only exchange is a handful of counters per host.

Defined results: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated
rows are judged (and counted) each by itself; an empty table gives an empty result; ``judge`` carries the columns named in
``key`` only, ``keep`` all columns whatever their names. A text is one row's work: it takes some dozen times its size in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import SPACE_CLASS, bind, cut, row

#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: How far above the corpus' failure rate, and how surely, a host must be for its documents' mild failures to count.
EXCESS, SURE = 1.2, 2.0


def _repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by 64-bit hashes of word hashes. Texts without a repeated window (most) never sort.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            marked = F.transform(p, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))
            return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

        def union(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return bind(bind(pairs, repeated), union)

    def of(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0).cast("long"))

    def doubled(h: Column, step: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def windows(h: Column) -> Column:
        # spans of 2, 4 and 8 words from spans half as long; those that run over the end are cut off
        return F.slice(bind(bind(h, lambda a: doubled(a, 1)), lambda b: bind(doubled(b, 2), lambda c: doubled(c, 4))), F.lit(1), F.size(h) - (WINDOW - 1))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bind(hashed, lambda h: F.when(F.size(h) > WINDOW, bind(windows(h), of)).otherwise(F.lit(0).cast("long")))


def measures(text: Column) -> Column:
    """What the rules look at, as one struct; null text counts as empty."""

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(F.transform(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))), lambda same: same)).cast("long").alias("n_stutter"),
        )

    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, SPACE_CLASS), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        bind(words, of_words).alias("w"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup"))).alias("l"),
        F.length(F.regexp_replace(whole, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def rules(docs: DataFrame, host: str = "source", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: its key, host, counts, and which rules it fails."""
    m = docs.select(*key, F.col(host).alias("host"), measures(F.col("text")).alias("m"))
    flat = m.select(*key, "host", "m.w.*", "m.n_symbols", F.col("m.l.dup").alias("n_dup_lines"), F.col("m.l.n").alias("n_lines"), "m.n_upper")
    n = F.col("n_words")
    return flat.select(
        *key,
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * n)).alias("base_failed"),
        ((10 * F.col("n_symbols") > n) | ((n >= MIN_WORDS) & (10 * F.col("n_upper") > 4 * F.col("word_chars"))) | (10 * F.col("n_stutter") > 3 * n)).alias("severe"),
        ((10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | ((n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)))).alias("mild"),
    )


def host_rates(judged: DataFrame, excess: float = EXCESS, sure: float = SURE) -> DataFrame:
    """Each host's failure rate, shrunk by a beta prior whose mean and strength are fitted to all hosts, and its verdict."""
    failed = F.col("base_failed") | F.col("severe") | F.col("mild")
    by = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("f"))
    rate = F.col("f") / F.col("n")
    moments = by.agg(F.sum("n").alias("N"), F.sum("f").alias("X"), F.count(F.lit(1)).alias("H"), F.sum(F.col("n") * rate * rate).alias("S"))
    mean = F.col("X") / F.col("N")
    noise = mean * (1 - mean)
    between = F.greatest(F.col("S") / F.col("N") - mean * mean - noise * F.col("H") / F.col("N"), F.lit(1e-9))
    prior = moments.select(mean.alias("mean"), F.greatest(noise / between - 1, F.lit(1.0)).alias("strength"))
    # prior is one row, whatever the input: attaching it pairs nothing
    shrunk = by.join(F.broadcast(prior)).withColumn("host_rate", (F.col("f") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength")))
    deviation = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n") + F.col("strength") + 1))
    return shrunk.select("host", "n", "f", "host_rate", (F.col("host_rate") - sure * deviation > excess * F.col("mean")).alias("distrusted"))


def _verdict(judged: DataFrame, rates: DataFrame) -> DataFrame:
    # the verdict travels to the documents: hosts are joined by key, and a host with a third of the rows is split by the skew join
    named = rates.select(F.col("host").alias("rated"), "host_rate", "distrusted")
    kept = ~F.col("base_failed") & ~F.col("severe") & ~(F.col("mild") & F.col("distrusted"))
    return judged.join(named, F.col("host").eqNullSafe(F.col("rated")), "left").withColumn("kept", kept)


def keep(docs: DataFrame, host: str = "source", excess: float = EXCESS, sure: float = SURE) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are read twice instead of being moved."""
    rates = cut(host_rates(rules(docs, host), excess, sure), "rates")
    # rows travel as one value, so that no name of theirs meets one of ours
    whole = docs.select(row(docs).alias("row"), F.col(host).alias("host"), "text")
    return _verdict(rules(whole, "host", ("row",)), rates).filter("kept").select("row.*")


def judge(docs: DataFrame, host: str = "source", excess: float = EXCESS, sure: float = SURE, key: tuple[str, ...] = ("doc_id",), staged=None) -> DataFrame:
    """Rules, hosts' verdicts, and ``kept`` for every document.

    ``staged`` may cut the lineage after the rules (see :func:`athenaeum.llm.common.cut`) so that texts are read once.
    """
    judged = rules(docs, host, key)
    judged = staged(judged) if staged else judged
    out = _verdict(judged, host_rates(judged, excess, sure))
    return out.select(*key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severe", "mild", "host_rate", "distrusted")
