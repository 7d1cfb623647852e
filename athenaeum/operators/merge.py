"""Writes into keyed tables, as plans that give the table's next state.

Tables are immutable files: a merge reads the old state and the new rows and gives what the table is afterwards, to be
written beside it and swapped in. All policies are one grouped pass over old and new rows by key: an equal key meets its
other half through one shuffle whichever policy holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]


def keep_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def fill(old: Column, new: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def fill_text(old: Column, new: Column) -> Column:
    """The new text unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def backfill(valid: Sequence[str]) -> Policy:
    """The old value unless it is null; then the new one if it is of the vocabulary."""
    return lambda old, new: F.coalesce(old, F.when(new.isin(*valid), new))


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, the first of each key by ``order``, appended."""
    keys = list(key)
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def insert_replace(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: of ``new`` by ``order``, else of ``old``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], policies: dict[str, Policy]) -> DataFrame:
    """Full outer merge; columns without a policy take the new value. Rows only one side has stay as they are."""
    keys = list(key)
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in rest])
    n = new.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in rest])
    made = []
    for c in rest:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        made.append(F.when(F.col("_o").isNull(), b).when(F.col("_n").isNull(), a).otherwise(policies.get(c, keep_new)(a, b)).alias(c))
    return o.join(n, keys, "full").select(*keys, *made)


def replace_partitions(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """All old rows of the keys that occur in ``new`` give way."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def mark_missing(old: DataFrame, live: DataFrame, scope: Column, key: str, flag: str) -> DataFrame:
    """``flag`` is set on rows in ``scope`` whose key isn't live (all of them if nothing is)."""
    seen = live.select(F.col(key).alias("_k")).distinct().withColumn("_live", F.lit(True))
    return old.join(seen, F.col(key) == F.col("_k"), "left").withColumn(flag, F.when(scope & F.col("_live").isNull(), True).otherwise(F.col(flag))).drop("_k", "_live")


def rename_keys(table: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """``renames``: old_id, new_id."""
    return table.join(renames, F.col(column) == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def delete(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return table.join(keys.select(F.col(keys.columns[0]).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """key and state (new, gone, updated, unchanged); ``same`` columns are compared null-safely."""
    o = old.select(key, F.struct(*same).alias("_o"))
    n = new.select(key, F.struct(*same).alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_o").eqNullSafe(F.col("_n")), "unchanged").otherwise("updated")
    return o.join(n, key, "full").select(key, state.alias("state"))


def publish(attempts: DataFrame) -> DataFrame:
    """The active run of each work: the latest that is published. Partial runs wait, failed ones never show."""
    done = attempts.filter(F.col("state") == "published")
    return done.groupBy("work_id").agg(F.max("run_id").alias("active_run"))


def longest_prefix(rows: DataFrame, types: DataFrame, column: str) -> DataFrame:
    """Adds ``type`` of the longest dotted prefix (or the section itself) that ``types`` (prefix, type) names.

    A section's prefixes are as many as its parts, so they are joined by equality; no row meets all types.
    """
    parts = F.split(F.col(column), r"\.")
    ways = rows.select(F.col(column).alias("_s")).filter(F.col(column).isNotNull()).distinct()
    parts = F.split("_s", r"\.")
    ways = ways.select("_s", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("prefix"))
    best = ways.join(types, "prefix").groupBy("_s").agg(F.max_by("type", F.length("prefix")).alias("type"))
    return rows.join(best, F.col(column) == F.col("_s"), "left").drop("_s")
