"""Runs that began and never ended: given up by a timer in a stream, by a window in a batch.

A run's messages are (run_id, at, state): "running" begins it (or begins it again), anything else ends it. A run that is still
running ``hours`` after it last began is failed at that time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

MADE = "run_id long, at timestamp, state string"


class GiveUp(StatefulProcessor):
    """For each run, when it last began and the timer that gives it up.

    The time it began is kept for ``days`` at most (a state's time to live), so that runs of which nothing is heard any more don't pile up.
    """

    def __init__(self, hours: float) -> None:
        self.after = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        said = pd.concat(list(rows)).sort_values(["at", "state"])
        began, out = self.began.get()[0] if self.began.exists() else None, []
        for at, state in zip(said["at"], said["state"], strict=True):
            now = at.value // 1_000_000 if at.unit == "ns" else int(at.timestamp() * 1000)
            if began is not None and now >= began + self.after:  # it was given up before this came
                out.append((key[0], pd.Timestamp(began + self.after, unit="ms"), "failed"))
                began = None
            out.append((key[0], at, state))
            began = now if state == "running" else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if began is None:
            self.began.clear()
        else:
            self.began.update((began,))
            self.handle.registerTimer(began + self.after)
        yield pd.DataFrame(out, columns=["run_id", "at", "state"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.began.clear()
        yield pd.DataFrame({"run_id": [key[0]], "at": [pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")], "state": ["failed"]})

    def close(self) -> None:
        pass


def given_up(messages: DataFrame, hours: float = 2.0, late: str = "10 minutes", now: str | None = None) -> DataFrame:
    """The messages, and a "failed" at its time for each run that went stale before ``now`` (a batch's; by default the last message)."""
    sent = messages.select(F.col("run_id").cast("long").alias("run_id"), F.col("at").cast("timestamp").alias("at"), "state")
    if messages.isStreaming:
        return sent.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(GiveUp(hours), MADE, "Append", "EventTime")
    limit = F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")
    clock = sent.agg((F.lit(now).cast("timestamp") if now else F.max("at")).alias("now"))
    following = Window.partitionBy("run_id").orderBy("at", "state")
    seen = sent.withColumn("then", F.lead("at").over(following)).join(F.broadcast(clock))  # one row
    stale = seen.filter((F.col("state") == "running") & (F.coalesce("then", "now") >= F.col("at") + limit))
    return sent.union(stale.select("run_id", (F.col("at") + limit).alias("at"), F.lit("failed").alias("state")))
