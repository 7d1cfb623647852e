"""Where quotations stand in texts: candidates meet by the rarest words of each quotation, then each is looked for.

How many texts hold a pair of neighbouring words is counted first, for the pairs that quotations have. A whole quotation lies
only in texts that hold its rarest pair, so it meets these and no others; if changes can spoil ``s`` of its pairs, it lies only in
texts that hold one of its ``s + 1`` rarest and all but ``s`` of all. Frequent pairs thus meet nothing, and candidates grow with
the places found and not with the texts.

Few quotations (:data:`LETTERS`) go to the texts instead: what changes may spoil is looked for while a text is read, once, and texts
are never dealt.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.functions import arrow

#: Share of a quotation's characters that may differ: one in so many.
CHANGED = 20
#: Grams of quotations that are sent to every task.
SENT = 100_000
#: Characters of all quotations up to which these are sent themselves.
LETTERS = 1 << 20


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: it is the one element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_pairs(text: Column, inner: bool = False) -> Column:
    """Hashes of a text's distinct pairs of neighbouring words; ``inner``: without its first and its last word, which may be cut."""

    def of(words: Column) -> Column:
        skip = 1 if inner else 0
        n = F.greatest(F.size(words) - 1 - 2 * skip, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(words, F.lit(1 + skip), n), F.slice(words, F.lit(2 + skip), n), lambda a, b: F.xxhash64(a, b)))

    return _once(F.split(F.trim(text), r"\s+"), of)


def rarest(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, gram): of each quotation's ``grams`` (item_id, wanted, gram) the ``wanted`` that fewest texts have (gram, texts)."""
    place = Window.partitionBy("item_id").orderBy(F.coalesce("texts", F.lit(0)), "gram")
    ordered = grams.join(counts, "gram", "left").withColumn("place", F.row_number().over(place))
    # what no text has takes a place but meets nothing
    return ordered.filter((F.col("place") <= F.col("wanted")) & F.col("texts").isNotNull()).select("item_id", "gram")


def met(texts: DataFrame, grams: DataFrame, of: Column) -> DataFrame:
    """(work_id, item_id) of every text (work_id, text) for each of a quotation's rarest grams that it holds; ``of``: a text's grams.

    The quotations' grams, and what is made of them, are sent to the texts if there are at most ``SENT``.
    """
    sent = F.broadcast if grams.limit(SENT + 1).count() <= SENT else lambda df: df
    held = texts.select("work_id", F.explode(of).alias("gram")).join(sent(grams.select("gram").distinct()), "gram", "left_semi")
    # what quotations have is dealt once and read twice: to be counted, and to be met. Counting by id keeps both readings alike
    held = held.repartition("work_id")
    counts = held.groupBy("gram").agg(F.count("work_id").alias("texts"))
    return held.join(sent(rarest(grams, counts)), "gram").select("work_id", "item_id")


def exact_candidates(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """Texts that hold a quotation's rarest pair of inner words. Quotations of under four words have none."""
    grams = quotes.select("item_id", F.lit(1).alias("wanted"), F.explode(word_pairs(F.col("q"), inner=True)).alias("gram"))
    return met(texts, grams, word_pairs(F.col("text")))


def exact(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """work_id, item_id and the first place (from 1) of every quotation in every text that holds it whole.

    Quotations of under four words are held against every text.
    """
    place = F.expr("cast(locate(q, text) as bigint)").alias("place")
    out = exact_candidates(texts, quotes).join(quotes, "item_id").join(texts, "work_id").filter(F.col("text").contains(F.col("q"))).select("work_id", "item_id", place)
    short = quotes.filter(F.size(word_pairs(F.col("q"), inner=True)) == 0)
    if short.limit(1).count():
        out = out.union(texts.join(short, F.col("text").contains(F.col("q"))).select("work_id", "item_id", place))
    return out


def changes(q: Column) -> Column:
    """Characters of a quotation that may differ."""
    return F.floor(F.length(q) / CHANGED).cast("int")


def spoiled(q: Column) -> Column:
    """Pairs that the allowed changes can spoil: three each, as a changed space touches three; two each, as a letter does, for
    quotations that could not spare more. Null where even that would be all."""
    n, k = F.size(word_pairs(q, inner=True)), changes(q)
    return F.when(n > 3 * k, 3 * k).when(n > 2 * k, 2 * k)


def pieces(q: Column) -> Column:
    """A text cut into one piece more than may be changed; one of them stands as it is wherever the text does."""
    n = changes(q) + 1
    size = F.ceil(F.length(q) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(q, i * size + 1, size))


def stands(text: Column, of: Column) -> Column:
    """Whether one of a quotation's pieces stands in the text."""
    return F.exists(of, lambda p: F.contains(text, p) & (p != ""))


def fuzzy_candidates(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(work_id, item_id) of texts that hold one of the rarest pairs of a quotation (item_id, q), all but the spoiled of its pairs, and a piece."""
    inner, lost = word_pairs(F.col("q"), inner=True), spoiled(F.col("q"))
    asked = quotes.select("item_id", inner.alias("asked"), lost.alias("lost"), pieces(F.col("q")).alias("pieces")).filter("lost IS NOT NULL")
    pairs = met(texts, asked.select("item_id", (F.col("lost") + 1).alias("wanted"), F.explode("asked").alias("gram")), word_pairs(F.col("text"))).distinct()
    sides = pairs.join(asked, "item_id").join(texts.select("work_id", "text", word_pairs(F.col("text")).alias("said")), "work_id")
    enough = F.size(F.array_intersect("asked", "said")) >= F.size("asked") - F.col("lost")
    return sides.filter(enough & stands(F.col("text"), F.col("pieces"))).select("work_id", "item_id")


class Asked(NamedTuple):
    """A quotation as it is looked for: squeezed, its inner pairs of words, how many may be missing (None: it has too few) and its pieces."""

    item: object
    q: str
    pairs: set[tuple[str, str]]
    lost: int | None
    pieces: list[str]


def asked(item: object, q: str) -> Asked:
    """What :func:`word_pairs`, :func:`spoiled` and :func:`pieces` say of one quotation."""
    words = arrow.squeezed_words(q)
    q, pairs = " ".join(words), set(zip(words[1:-2], words[2:-1], strict=True))
    k, n = len(q) // CHANGED, len(pairs)
    size = -(-len(q) // (k + 1))
    cut = [q[i * size : (i + 1) * size] for i in range(k + 1)]
    return Asked(item, q, pairs, 3 * k if n > 3 * k else 2 * k if n > 2 * k else None, [p for p in cut if p])


def reader(quotes: list[tuple[object, str]]) -> Callable[[str], Iterator[tuple[object, tuple[int, int]]]]:
    """What finds the items and spans of all quotations (item, q) in a text. Of each, those pairs are looked up that fewest quotations have."""
    every = [a for a in (asked(*x) for x in quotes) if a.q]
    short, long = [a for a in every if a.lost is None], [a for a in every if a.lost is not None]
    held = Counter(p for a in long for p in a.pairs)
    by_pair: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, a in enumerate(long):
        for p in sorted(a.pairs, key=lambda p: (held[p], p))[: a.lost + 1]:
            by_pair[p].append(i)
    known = frozenset(by_pair)

    def read(text: str) -> Iterator[tuple[object, tuple[int, int]]]:
        words = arrow.squeezed_words(text)
        said = set(zip(words, words[1:], strict=False))
        near = [a for a in map(long.__getitem__, {i for p in known & said for i in by_pair[p]}) if len(a.pairs & said) >= len(a.pairs) - a.lost]
        if not (near or short):
            return
        plain = " ".join(words)
        if near := [a for a in near + short if any(p in plain for p in a.pieces)]:
            squeezed = arrow.squeeze_with_places(text)
            for a in near:
                if span := arrow.located(a.q, *squeezed):
                    yield a.item, span

    return read


def _read(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """:func:`fuzzy` where every task is sent all quotations."""
    few = quotes.select("item_id", "q").toArrow().combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, items = reader(list(enumerate(sent.value.column("q").to_pylist()))), sent.value.column("item_id").combine_chunks()
        for batch in batches:
            found = [(i, k, *span) for i, text in enumerate(batch.column("text")) if text.is_valid for k, span in read(text.as_py())]
            at, asked, starts, ends = (pa.array([x[c] for x in found], pa.int32()) for c in range(4))
            yield pa.RecordBatch.from_arrays([batch.column("work_id").take(at), items.take(asked), starts, ends], names=["work_id", "item_id", "start", "end"])

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for df, k in ((texts, "work_id"), (quotes, "item_id")))
    made = texts.select("work_id", "text").mapInArrow(run, f"{kinds}, start int, end int")
    return made.select("work_id", "item_id", F.struct("start", "end").alias("span"))


def fuzzy(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """work_id, item_id and the span of every quotation in every text that holds it with up to a twentieth of its characters changed.

    Quotations with too few words to lose some are held against every text, by pieces of which one must stand. Tests measure the recall.
    """
    quotes = quotes.filter("q IS NOT NULL")
    if (quotes.agg(F.sum(F.length("q"))).first()[0] or 0) <= LETTERS:
        return _read(texts, quotes)
    return _dealt(texts, quotes)


def _dealt(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """:func:`fuzzy` for any number of quotations: texts are dealt to those they may hold."""
    plain = texts.select("work_id", arrow.squeeze_udf("text").alias("text"))
    asked = quotes.select("item_id", arrow.squeeze_udf("q").alias("q")).filter("q <> ''")
    found = fuzzy_candidates(plain, asked)
    short = asked.filter(spoiled(F.col("q")).isNull())
    if short.limit(1).count():
        found = found.union(plain.join(short.select("item_id", pieces(F.col("q")).alias("pieces")), stands(F.col("text"), F.col("pieces"))).select("work_id", "item_id"))
    both = found.distinct().join(quotes, "item_id").join(texts, "work_id")
    return both.select("work_id", "item_id", arrow.locate_udf("q", "text").alias("span")).filter(F.col("span.start").isNotNull())
