"""Places and running values of rows within groups of any size.

A group may hold most of all rows, so none is sorted in one task: rows are dealt by ranges of (group, order), and what lies in
ranges before is added from one small row for each range and group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.llm.common import cut

#: Rows of one run of :func:`running`.
RUN = 1024


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank``, each row's place from 0 among the rows of its ``keys``. Keys are not null; nulls of ``order`` come first.

    The places are read off the written rows, so a task that runs again cannot shift them. Alike rows get places of their own.
    """
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(sorted_rows.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", *keys).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n") - F.col("first")
    return placed.join(runs.select("part", *keys, before.alias("shift")), ["part", *keys]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def running(df: DataFrame, keys: list[str], place: str, values: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """``df`` with every column of ``values`` turned into its running value by ``place`` (distinct within ``keys``, dense enough).

    A value has an aggregate and what puts two of its results together. Runs of ``RUN`` places are summed up, then the runs.
    """
    run = F.floor(F.col(place) / RUN)
    dealt = df.withColumn("run", run)
    totals = dealt.groupBy(*keys, "run").agg(*[f(F.col(c)).alias(f"{c}_run") for c, (f, _) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "run", *[f(F.col(f"{c}_run")).over(ahead).alias(f"{c}_run") for c, (f, _) in values.items()])
    inside = Window.partitionBy(*keys, "run").orderBy(place)
    summed = dealt.withColumns({c: f(F.col(c)).over(inside) for c, (f, _) in values.items()})
    both = summed.join(before, [*keys, "run"])
    return both.withColumns({c: F.coalesce(put(F.col(c), F.col(f"{c}_run")), F.col(c)) for c, (_, put) in values.items()}).drop("run", *[f"{c}_run" for c in values])
