"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (expected copies) that is exponentially tilted by its size, ``rate = cap * sigmoid(t * size)``:
the maximum-entropy choice among copy counts 0..cap (prior: binomial, a half each) that meets its source's token target in
expectation. The tilt ``t`` of each source is the minimum of a convex dual in one variable, found by Newton steps that are
each one distributed aggregate; a bracket keeps a step that would leave it. Rates are then rounded into whole copies by
carrying the fraction along each source's documents in order of size (systematic rounding: a source's words miss its
target by half its largest document at most), starting at that of ``STARTS`` offsets which misses least.

All of it is DataFrame functions. Documents enter the iterations as counts per (source, size), a table bounded by the
number of distinct sizes, and no step ever sees a source's documents in one task: the carry runs over chunks of cells,
then over cells, then over at most ``CELL`` documents.

Defined results: null text has size 0; null source is a source of its own, last in order; documents of size 0 are never
taken; repeated rows are documents of their own; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.llm.common import cut, drop, rank, row

#: Weights dealt to the sources in order, the mix's share of all words, the most of a source and of a document.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
#: Documents of one (source, size) that are rounded together.
CELL = 1024
STARTS = 32
MAX_STEPS, TOGETHER = 60, 4
CLOSE = 1e-7


#: A run of word characters; runs collapse to one letter and the letters are counted.
WORD_RUN = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of the text."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_RUN, "w")
    return (F.length(inner) - F.length(F.replace(inner, F.lit("w"), F.lit("")))).cast("long")


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): weighted shares of ``share`` of all words, none above ``cap`` times its size.

    Water filling in closed form: sources that stop first are those with the least room per weight; after the first k of
    them have stopped, the rest share what is left by weight, and k is the first for which the next doesn't stop.
    One row per source, so the windows over all of them are small.
    """
    ranked = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    room = (cap * F.col("source_size")).cast("double")
    filled = ranked.withColumn("weight", weight).withColumn("room", room)
    by_room = Window.orderBy(F.col("room") / F.col("weight"), "place")
    everyone = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        filled.withColumn("left", share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("open", F.col("weight") * F.col("level") <= F.col("room"))
    )
    # once one source stays open, all later ones do, at the level of the first of them
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, 0))
    return filled.withColumn("level", level).select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("room")).alias("target"))


def _sigmoid(x: Column) -> Column:
    # e^-|x| never overflows
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def tilts(cells: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """Solves every source's dual: adds ``tilt`` (null where the target is all that the cap allows) to ``wanted``.

    One step: the gradient and curvature of each source over all cells (an aggregate), then Newton, or halving where
    Newton leaves the bracket. ``TOGETHER`` steps run as one job and are cut in the shared folder; only whether a source is
    unsettled is fetched.
    """
    ratio = F.col("target") / (cap * F.col("source_size"))
    start = wanted.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("source_size") / F.col("docs")).otherwise(F.lit(1.0)).alias("unit"),
        F.when((F.col("source_size") > 0) & (ratio < 1 - 1e-12), F.ln(ratio / (1 - ratio))).alias("tilt"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("settled"),
    )
    carried = [c for c in start.columns if c != "source"]

    def step(state: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("unit")
        p = _sigmoid(F.col("tilt") * x)
        words = F.sum(F.col("n") * F.col("size") * cap * p)
        slope = F.sum(F.col("n") * F.col("size") * cap * p * (1 - p) * x)
        met = cells.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        got = met.groupBy("source").agg(words.alias("words"), slope.alias("slope"), *[F.first(c).alias(c) for c in carried])
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(miss >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > low) & (newton < high)
        done = F.col("settled") | F.col("tilt").isNull() | (F.abs(miss) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0))) | (high - low <= 1e-12 * F.greatest(F.lit(1.0), F.abs(F.col("tilt"))))
        tilt = F.when(done, F.col("tilt")).when(inside, newton).otherwise(F.sinh((F.asinh(low) + F.asinh(high)) / 2))
        return got.select("source", "source_size", "target", "unit", tilt.alias("tilt"), low.alias("low"), high.alias("high"), done.alias("settled"))

    state = cut(start, "tilts")
    for _ in range(MAX_STEPS // TOGETHER):
        after = state
        for _ in range(TOGETHER):
            after = step(after)
        after = cut(after, "tilts")
        drop(state)
        state = after
        if not state.filter(~F.col("settled")).limit(1).count():
            break
    else:
        raise RuntimeError(f"the mix did not settle in {MAX_STEPS} steps")
    return state.select("source", "source_size", "target", "unit", "tilt")


def copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Copies for every row of ``sized`` (doc_id, source, size, mark and others): adds source_size, target, rate, copies, taken.

    ``mark`` is a number that deals documents of one source and size into parts and orders them there.
    """
    per_size = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    wanted = targets(sources, weights, share, cap).join(sources.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    solved = cut(tilts(per_size, wanted, cap), "solved")
    # cells: a (source, size) with many documents is dealt into parts by a hash of the id
    keyed = per_size.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(cap * _sigmoid(F.col("tilt") * F.col("size") / F.col("unit")))
    cells = cut(keyed.select("source", "size", "source_size", "target", rate.alias("rate"), F.greatest(F.ceil(F.col("n") / CELL), F.lit(1)).alias("parts")), "cells")
    c = cells.select(F.col("source").alias("cs"), F.col("size").alias("cz"), "source_size", "target", "rate", "parts")
    placed = sized.join(c, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz"))).drop("cs", "cz")
    drop(solved)
    drop(per_size)
    placed = cut(placed.withColumn("part", F.pmod("mark", "parts")).drop("parts"), "placed")
    drop(cells)
    # fractions of copies before each cell: over chunks of a source, then over the cells of a chunk
    cell = placed.groupBy("source", "size", "part", "rate", "target").agg(F.count(F.lit(1)).alias("n"))
    cell = cell.withColumn("chunk_size", F.floor(F.col("size") / 64)).withColumn("chunk_part", F.floor(F.col("part") / 64))
    whole = F.floor(F.col("rate"))
    fraction = F.col("n") * (F.col("rate") - whole)
    chunk = ["source", "chunk_size", "chunk_part"]
    chunks = cell.groupBy(*chunk).agg(F.sum(fraction).alias("sum"))
    over = Window.partitionBy("source").orderBy("chunk_size", "chunk_part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("base", F.coalesce(F.sum("sum").over(over), F.lit(0.0))).select(*[F.col(k).alias(f"_{k}") for k in chunk], "base")
    within = Window.partitionBy(*chunk).orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    cell = cell.withColumn("within", F.coalesce(F.sum(fraction).over(within), F.lit(0.0)))
    cell = cell.join(chunks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk_size") == F.col("_chunk_size")) & (F.col("chunk_part") == F.col("_chunk_part")))
    cell = cut(cell.select("source", "size", "part", "rate", "target", "n", (F.col("base") + F.col("within")).alias("ahead")), "ahead")
    # the offset at which each source's words come nearest its target
    starts = [(j + 0.5) / STARTS for j in range(STARTS)]
    taken_at = [F.sum(F.col("size") * (F.col("n") * whole + F.floor(F.col("ahead") + fraction + u) - F.floor(F.col("ahead") + u))).alias(f"u{j}") for j, u in enumerate(starts)]
    sums = cell.groupBy("source").agg(F.first("target").alias("target"), *taken_at)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"u{j}") - F.col("target")).alias("miss"), F.lit(u).alias("u")) for j, u in enumerate(starts)]))["u"]
    at = cell.join(sums.select(F.col("source").alias("_s"), best.alias("u")), F.col("source").eqNullSafe(F.col("_s")))
    at = at.select(F.col("source").alias("as"), F.col("size").alias("az"), F.col("part").alias("ap"), (F.col("ahead") + F.col("u")).alias("ahead"))
    order = Window.partitionBy("source", "size", "part").orderBy("mark", "doc_id")
    numbered = placed.withColumn("nth", F.row_number().over(order))
    numbered = numbered.join(at, F.col("source").eqNullSafe(F.col("as")) & (F.col("size") == F.col("az")) & (F.col("part") == F.col("ap"))).drop("as", "az", "ap")
    # a document takes the extra copy where the running total passes a whole number
    total = lambda k: F.floor(F.col("ahead") + k * (F.col("rate") - whole))
    n = F.least(whole + total(F.col("nth")) - total(F.col("nth") - 1), F.lit(cap))
    return numbered.withColumn("copies", F.when(F.col("size") > 0, n).otherwise(F.lit(0)).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("part", "nth", "ahead", "mark")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Sizes every document and mixes them; one row per document."""
    mark = F.xxhash64("doc_id", "text", F.lit(17))
    sized = cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), mark.alias("mark")), "sized")
    made = copies(sized, weights, share, cap).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
    drop(sized)
    return made


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows alike in id, text and source share their copies, which the first of them by its other columns stands for.
    """
    key = {"_id": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "_hash": F.xxhash64("text"), "_source": F.xxhash64("source")}
    keyed = docs.select(row(docs).alias("_row"), rank(docs, "doc_id", "text", "source").alias("_rank"), "doc_id", "source", "text", F.xxhash64("doc_id", "text", F.lit(17)).alias("mark"), *[c.alias(k) for k, c in key.items()])
    sized = cut(keyed.select("doc_id", "source", size_of(F.col("text")).alias("size"), "mark", *key), "sized")
    taken = copies(sized, weights, share, cap).groupBy(*key).agg(F.sum("copies").alias("_copies")).filter(F.col("_copies") > 0)
    drop(sized)
    found = keyed.select("_row", "_rank", *key).join(taken, list(key)).groupBy(*key).agg(F.min_by("_row", "_rank").alias("_row"), F.first("_copies").alias("_copies"))
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
