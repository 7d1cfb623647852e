"""Results kept under what they were made from: a second run reads the first one's rows, until what they rest on changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from athenaeum.operators.shared import exists, remove
from athenaeum.sources.files import read_current, write_swapped


def state_key(rows: DataFrame, *columns: str) -> str:
    """A key of the set of a table's distinct rows, whatever their order: how many, and sums of their digests. One row reaches the driver."""
    whole = F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    hashed: Column = F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(13)))
    return rows.select(whole.alias("h")).distinct().agg(hashed.alias("key")).first()[0]


class Results:
    """Tables under ``root``, one for each (user, project, state of the library, state of the outline, model).

    A result is written beside its place and swapped in, so a reader finds the whole of it or nothing; a run that dies leaves no hit.
    Names may hold any characters.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, *parts: str) -> str:
        named = [hashlib.sha256(p.encode()).hexdigest()[:32] for p in parts[:2]]
        if len(parts) > 2:
            named.append(hashlib.sha256("\0".join(f"{len(p)}:{p}" for p in parts[2:]).encode()).hexdigest())
        return "/".join([self.root, *named])

    def find(self, user: str, project: str, library: str, outline: str, model: str) -> DataFrame | None:
        """The rows kept for exactly these five, or None."""
        at = self._at(user, project, library, outline, model)
        return read_current(self.spark, at) if exists(self.spark, f"{at}/current") else None

    def get(self, user: str, project: str, library: str, outline: str, model: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
        """The rows and whether they were there; what is missing is made and kept."""
        found = self.find(user, project, library, outline, model)
        if found is not None:
            return found, True
        at = self._at(user, project, library, outline, model)
        write_swapped(make(), at, "1")
        return read_current(self.spark, at), False

    def invalidate(self, user: str, project: str | None = None) -> None:
        """Forgets a project's results, or all of a user's."""
        remove(self.spark, self._at(user, *([project] if project is not None else [])))
