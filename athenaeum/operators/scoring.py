"""Scores of missing works, and rules over coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.operators.sizes import bounded, tasks
from athenaeum.operators.vectors import dot, unit, units
from athenaeum.schemas import INTENT_WEIGHTS


def intent_weight(intent: Column, unknown: float | None = 1.0) -> Column:
    """The weight of an intent; ``unknown`` for null and foreign ones (None: they don't count)."""
    out = F.lit(unknown).cast("double")
    for name, weight in INTENT_WEIGHTS.items():
        out = F.when(intent == name, F.lit(weight)).otherwise(out)
    return out


def gap_scores(edges: DataFrame, quality: DataFrame | None = None, key: str = "cited", unknown: float | None = 1.0, default_quality: float = 3.0, rows: int | None = None) -> DataFrame:
    """For each cited work: distinct citing works x mean quality x mean intent weight.

    Without ``quality`` (citing, quality) the edges have that column. With ``unknown`` None, null and foreign intents drop out of
    the mean (1 if none is left); else they weigh that much.

    Citing works are dealt to as many tasks as ``rows`` (how many edges there are; counted if not given) need, before anything is
    sorted or grouped: repeated citations are told apart where they lie, and what a task holds doesn't grow with the edges.
    """
    weighed = edges.withColumn("weight", intent_weight(F.col("intent"), unknown))
    dealt = weighed.repartition(tasks(edges.sparkSession, edges.count() if rows is None else rows), "citing")
    joined = dealt.join(quality, "citing", "left") if quality is not None else dealt
    each = joined.groupBy(key, "citing").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("quality").cast("double"), F.lit(default_quality))).alias("q"),
        F.sum("weight").alias("w"), F.count("weight").alias("of"),
    )
    grouped = each.groupBy(key).agg(
        F.count("citing").alias("citing_works"),
        (F.sum("q") / F.sum("n")).alias("mean_quality"),
        F.coalesce(F.sum("w") / F.nullif(F.sum("of"), F.lit(0)), F.lit(1.0)).alias("mean_weight"),
    )
    return grouped.withColumn("score", F.col("citing_works") * F.col("mean_quality") * F.col("mean_weight"))


def top_intent(edges: DataFrame, key: str = "cited") -> DataFrame:
    """What each cited work is cited for most often; of equally frequent intents the weightiest, then the last by name."""
    each = edges.filter(F.col("intent").isin(*INTENT_WEIGHTS)).groupBy(key, "intent").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.max(F.struct("n", intent_weight(F.col("intent")).alias("w"), "intent")).alias("best")).select(key, F.col("best.intent").alias("top_intent"))


def semantic_factor(edges: DataFrame, vectors: DataFrame, centroids: DataFrame, dim: int, key: str = "cited") -> DataFrame:
    """For each cited work 0.5 + 0.5 x the mean cosine of its citing works (id, v) with the section (target, centroid) they are nearest to.

    It lies in [0.5, 1] and is a penalty for what fits no section: works with fewer than two citing vectors, and all works if
    there is no centroid, have no row and count as 1. A mean of cosines with one direction is the cosine of the mean of unit
    vectors, so each work is averaged once, whatever the number of sections; centroids (one for each section of an outline) travel as
    one row.
    """
    sized = vectors.filter(F.size("v") == dim).select(F.col("id").alias("citing"), units(F.col("v"), dim).alias("u"))
    directions = bounded(centroids.filter(F.size("centroid") == dim).agg(F.collect_list(unit(F.col("centroid"))).alias("directions")), 1)
    means = F.array(*[F.avg(F.get("u", F.lit(i))) for i in range(dim)])
    # works without a vector leave before repeated citations are told apart
    told = edges.select(key, "citing").join(vectors.filter(F.size("v") == dim).select(F.col("id").alias("citing")), "citing", "left_semi").distinct()
    each = told.join(sized, "citing").groupBy(key).agg(means.alias("mean"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    best = F.array_max(F.transform("directions", lambda c: dot(F.col("mean"), c)))
    return each.join(directions).filter(F.size("directions") > 0).select(key, (0.5 + 0.5 * F.greatest(F.lit(0.0), best)).alias("factor"))


def recent_or_classic(year: Column, measure: Column, today: int, max_age: int, classic: float) -> Column:
    """True for rows without a year, young ones, and old ones that measure up."""
    return F.coalesce(year, F.lit(0)).eqNullSafe(0) | (F.lit(today) - year <= max_age) | F.coalesce(measure >= classic, F.lit(False))


def feedback(decisions: DataFrame, notes: int = 10) -> DataFrame:
    """topic, likes, dislikes and the last ``notes`` of each topic (id, at), latest first, of decisions (id, at, context as JSON, verdict).

    A topic is the context's type, or "unknown". Each task keeps its own last few of each topic (a ranked window that is cut before
    the shuffle), so that a topic with most of all rows is never gathered.
    """
    typed = decisions.withColumn("topic", F.coalesce(F.get_json_object("context", "$.type"), F.lit("unknown")))
    place = Window.partitionBy("topic").orderBy(F.desc("at"), F.desc("id"))
    last = typed.filter("verdict IS NOT NULL").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= notes)
    lists = last.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id", "at"))), lambda n: F.struct(n["id"].alias("id"), n["at"].alias("at"))).alias("notes"))
    counts = typed.groupBy("topic").agg(F.count_if(F.col("verdict") == "like").alias("likes"), F.count_if(F.col("verdict") == "dislike").alias("dislikes"))
    return counts.join(lists, "topic", "left")


def suggestions(moves: DataFrame, skips: DataFrame) -> DataFrame:
    """Of moves (work, current, suggested, id, score, delta) one for each (work, current, suggested): the highest score, the least id of
    equals, and how many it stands for. Those that ``skips`` (work, suggested) names are left out."""
    best = F.max(F.struct("score", (-F.col("id")).alias("i"), "delta")).alias("best")
    kept = moves.join(skips.select("work", "suggested").distinct(), ["work", "suggested"], "left_anti")
    grouped = kept.groupBy("work", "current", "suggested").agg(best, F.count(F.lit(1)).alias("moves"))
    return grouped.select("work", "current", "suggested", (-F.col("best.i")).alias("id"), "best.score", "best.delta", "moves")
