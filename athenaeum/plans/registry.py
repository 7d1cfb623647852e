"""Registered queries: each is a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from athenaeum.sources.tables import Tables, with_tables


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a plan over :class:`Tables` under its function's name."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[plan.__name__] = Query(lambda spark, sf_dir: plan(Tables(spark, sf_dir)), with_tables(sql) if sql else None)
        return plan

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["e8_gap_score_library"].run(spark, sf_dir)


def load() -> dict[str, Query]:
    """All plans; importing a module registers its queries."""
    from athenaeum.plans import analytics, evaluation, joins, mutation, scans, streams, text, vectors  # noqa: F401

    return QUERIES
