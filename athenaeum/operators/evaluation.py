"""Evaluation metrics as plans; ranks and sets are joined, never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def class_metrics(pairs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class; ``pairs``: predicted, actual. Both sides count inside ``classes``."""
    known = pairs.filter(F.col("predicted").isin(*classes) & F.col("actual").isin(*classes))
    cells = known.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select(F.explode(F.array(F.struct(F.col("predicted").alias("class"), F.col("n").alias("p"), F.lit(0).cast("long").alias("a"), F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("actual").alias("class"), F.lit(0).cast("long").alias("p"), F.col("n").alias("a"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("x.*")
    g = rows.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("a").alias("support"))
    g = g.withColumns({"precision": ratio(F.col("tp"), F.col("p")), "recall": ratio(F.col("tp"), F.col("support"))})
    return g.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "support", "precision", "recall", "f1")


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """precision, recall and nDCG at k for each query; ``ranked``: query, item, score; ``relevant``: query, item, gain > 0.

    A query's repeated items count once (its best place). Precision divides by min(k, items ranked), recall by all relevant.
    """
    once = ranked.groupBy("query", "item").agg(F.max("score").alias("score"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")))
    top = placed.filter(F.col("place") <= k).join(relevant, ["query", "item"], "left")
    gain = F.pow(F.lit(2.0), F.col("gain")) - 1
    hits = top.groupBy("query").agg(F.count(F.lit(1)).alias("ranked"), F.count("gain").alias("hits"), F.coalesce(F.sum(gain / F.log2(F.col("place") + 1)), F.lit(0.0)).alias("dcg"))
    ideal_place = relevant.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "item")))
    ideal = ideal_place.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("best"))
    return ideal.join(hits, "query").select("query", ratio(F.col("hits"), F.col("ranked")).alias("precision"), ratio(F.col("hits"), F.col("relevant")).alias("recall"), ratio(F.col("dcg"), F.col("best")).alias("ndcg"))


def set_metrics(predicted: DataFrame, truth: DataFrame, group: str, item: str) -> DataFrame:
    """Precision, recall and F1 of each group that the truth has; repeats count once."""
    p, t = predicted.select(group, item).distinct().withColumn("p", F.lit(1)), truth.select(group, item).distinct().withColumn("t", F.lit(1))
    known = truth.select(group).distinct()
    both = p.join(known, group, "left_semi").join(t, [group, item], "full").groupBy(group).agg(F.count("p").alias("np"), F.count("t").alias("nt"), F.count(F.col("p") + F.col("t")).alias("hit"))
    m = both.select(group, ratio(F.col("hit"), F.col("np")).alias("precision"), ratio(F.col("hit"), F.col("nt")).alias("recall"))
    return m.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta; null where a run lacks the metric. Runs are (metric, value)."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full")
    return both.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))
