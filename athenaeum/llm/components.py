"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is joins and aggregates over the links; nothing is gathered anywhere. Links are pairs (a, b) of longs. Every
round is cut in the shared folder, and one checksum per round is fetched to see whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import cut, drop

MAX_ROUNDS = 100


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. Links point from larger to smaller here."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the component's least node and its own root."""
    tidy = lambda df: df.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    checksum = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    state = cut(tidy(links), "links")
    seen = checksum(state)
    for _ in range(MAX_ROUNDS):
        after = cut(tidy(_small(tidy(_large(state)))), "links")
        now = checksum(after)
        drop(state)
        state = after
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b").distinct())
