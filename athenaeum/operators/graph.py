"""What a row rests on, directly and through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.operators.shared import settled

#: Doublings after which a path of any length that a table can hold is closed.
ROUNDS = 60


def reachable(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) of all that ``a`` reaches by links (a, b), itself left out; members of a cycle reach each other.

    Paths double in length each round: what was new in the last is joined to all that is known, so a chain of ``n`` takes ``log2 n``
    rounds. Raises where ``rounds`` don't settle it.
    """
    tidy = links.select("a", "b").filter("a <> b").distinct()
    known = new = settled(tidy)
    for _ in range(rounds):
        if not new.head(1):
            return known
        by = lambda x, y: x.select("a", F.col("b").alias("via")).join(y.select(F.col("a").alias("via"), "b"), "via").select("a", "b")
        longer = by(known, new).union(by(new, known)).filter("a <> b").distinct()
        new = settled(longer.join(known, ["a", "b"], "left_anti"))
        known = settled(known.union(new))
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def trail(decisions: DataFrame) -> DataFrame:
    """Decisions (id, at, influenced_by as a JSON list of ids) in order of time, each with its direct influences that are decisions
    and all that it rests on. A list that isn't JSON is empty; influences by oneself or by no decision don't count."""
    listed = decisions.select("id", "at", F.coalesce(F.from_json("influenced_by", "array<long>"), F.array().cast("array<long>")).alias("listed"))
    ids = decisions.select(F.col("id").alias("b")).distinct()
    links = listed.select(F.col("id").alias("a"), F.explode("listed").alias("b")).join(ids, "b", "left_semi").select("a", "b").filter("a <> b").distinct()
    gather = lambda df, name: df.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_list("b")).alias(name))
    none = F.array().cast("array<long>")
    out = decisions.select("id", "at").join(gather(links, "influences"), "id", "left").join(gather(reachable(links), "rests_on"), "id", "left")
    return out.select("id", "at", F.coalesce("influences", none).alias("influences"), F.coalesce("rests_on", none).alias("rests_on")).orderBy("at", "id")
