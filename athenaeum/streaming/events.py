"""Structured Streaming over the events table, each with a batch twin that must agree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    counted = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.window("ts", width), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of overlapping windows. Each event is added to one pane as long as the slide; windows are sums of panes, so
    the work on events doesn't grow with the number of windows they lie in. ``width`` is a multiple of ``slide``."""
    panes = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.window("ts", slide).alias("pane"), "event_type")
    panes = panes.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    windows = panes.groupBy(F.window(F.window_time("pane"), width, slide).alias("window"), "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.session_window("ts", gap), "user_id")
    return counted.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _limit(times: list[float], now: float, most: int, width: float) -> bool:
    """Whether one more call is let through; ``times`` are those let through lately, and are kept up to date."""
    times[:] = [t for t in times if t > now - width]
    if len(times) >= most:
        return False
    times.append(now)
    return True


LIMITED = "event_id long, user_id long, allowed boolean"


def limiter(events: DataFrame, most: int = 2, seconds: float = 3600.0) -> DataFrame:
    """A sliding-window limiter for each user: calls beyond ``most`` in ``seconds`` are refused, and refused ones don't count.

    State for each user are the times let through, ``most`` at the most. In a stream calls are taken in order of time
    within a trigger; a batch takes all in order.
    """
    if events.isStreaming:

        def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            times = list(state.get[0]) if state.exists else []
            for rows in [pd.concat(list(parts)).sort_values(["ts", "event_id"])]:
                allowed = [_limit(times, t.timestamp(), most, seconds) for t in rows["ts"]]
                yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})
            state.update((times,))

        return events.groupBy("user_id").applyInPandasWithState(step, LIMITED, "times array<double>", "append", "NoTimeout")

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, times = None, []
        for rows in parts:
            allowed = []
            for u, at in zip(zip(rows["nobody"], rows["user_id"], strict=True), rows["at"], strict=True):
                if u != user:
                    user, times = u, []
                allowed.append(_limit(times, at, most, seconds))
            yield pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"].astype("Int64").mask(rows["nobody"]), "allowed": allowed})

    # calls pass by in order; what is held is one user's times, however many calls there are; calls without a user share a limit
    sent = events.select("event_id", F.coalesce("user_id", F.lit(0)).alias("user_id"), F.col("user_id").isNull().alias("nobody"), (F.unix_micros("ts") / 1e6).alias("at"))
    return sent.repartition("nobody", "user_id").sortWithinPartitions("nobody", "user_id", "at", "event_id").mapInPandas(whole, LIMITED)


def merge_each(events: DataFrame, root: str, checkpoint: str):
    """Latest event of each user, kept as a table that every trigger rewrites beside the old one and swaps in.

    A trigger that is run again writes the same version again, so replays change nothing.
    """
    from athenaeum.operators.merge import insert_replace
    from athenaeum.sources.files import read_current, write_swapped

    def apply(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "ts", "event_id", "event_type")
        old = read_current(batch.sparkSession, root) if number else new.limit(0)
        write_swapped(insert_replace(old, new, ["user_id"], ["ts", "event_id"]), root, f"{number:08d}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
