"""The library's logical tables over the provided ones, as DataFrames and (for the oracle) as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


class Tables:
    """Reads lazily; a query's columns and filters reach the scans."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def listed(self) -> DataFrame:
        """The works without what labels tell of them."""
        i = F.col("doc_id")
        chapter = (i % 7 + 1).cast("int")
        return self.raw("documents").select(
            i.alias("work_id"),
            F.trim(F.regexp_extract("text", r"^[^.\n]*", 0)).alias("title"),
            F.concat(F.lit("Author"), (i % 97).cast("string"), F.lit(", A.")).alias("authors"),
            F.when(i % 11 != 0, 1990 + i % 35).cast("int").alias("year"),
            F.when(i % 3 == 0, F.concat(F.lit("10.1234/W"), (i % 400).cast("string"))).alias("doi"),
            pick(("completed", "pending", "failed", "skipped", "processing"), i % 5).alias("status"),
            chapter.alias("chapter"),
            F.concat_ws(".", chapter, (i % 12 + 1).cast("int")).alias("section"),
            pick(("high", "medium", "low"), i % 3).alias("priority"),
            F.col("lang"), F.col("source").alias("collection"), F.col("text"),
        )

    @cached_property
    def works(self) -> DataFrame:
        quality = F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1)
        labels = self.raw("labels").select(F.col("doc_id").alias("labelled"), quality.cast("int").alias("quality"), F.col("toxic").cast("int").alias("flagged"))
        # titles are taken before labels join, so texts are shuffled only where they are read
        return self.listed.join(labels, F.col("work_id") == F.col("labelled"), "left").select(
            "work_id", "title", "authors", "year", "doi", "status", "quality", "chapter", "section", "priority", "lang", "collection", "text", "flagged",
        )

    @cached_property
    def fragments(self) -> DataFrame:
        chapter = (F.col("l_suppkey") % 7 + 1).cast("int")
        kind = F.when(F.col("l_returnflag") == "A", "quote").when(F.col("l_returnflag") == "R", "summary")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fragment_id"), F.col("l_orderkey").alias("work_id"),
            F.concat_ws(" ", F.lit("fragment"), "l_partkey", "l_suppkey").alias("text"), kind.alias("kind"), chapter.alias("chapter"),
            F.concat_ws(".", chapter, (F.col("l_partkey") % 12 + 1).cast("int")).alias("section"),
            (F.col("l_quantity").cast("int") % 5 + 1).alias("relevance"), F.when(F.col("l_linenumber") != 7, self._intent()).alias("intent"),
            F.col("l_shipdate").alias("added"),
        )

    @staticmethod
    def _intent() -> Column:
        flags = F.concat("l_returnflag", "l_linestatus")
        out = F.lit("uses_data")
        for value, intent in (("AF", "method"), ("AO", "extends"), ("RF", "result_comparison"), ("RO", "contrasts"), ("NF", "background")):
            out = F.when(flags == value, intent).otherwise(out)
        return out

    @cached_property
    def edges(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), F.col("l_linenumber").cast("int").alias("line"), self._intent().alias("intent"))

    @cached_property
    def cited(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("cited"), F.concat_ws(" ", "p_name", "p_partkey").alias("title"), F.col("p_brand").alias("authors"),
            (1975 + F.col("p_size")).cast("int").alias("year"), (F.col("p_size") <= 10).alias("owned"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("section"), F.col("embedding").alias("v"))

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("ts").alias("seen"), "user_id", F.col("event_type").alias("operation"), F.col("value").alias("amount"), "props")


_INTENT = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'method' WHEN 'AO' THEN 'extends' WHEN 'RF' THEN 'result_comparison' WHEN 'RO' THEN 'contrasts' WHEN 'NF' THEN 'background' ELSE 'uses_data' END"

#: The same tables for the oracle, each as the body of a common table expression.
SQL = {
    "works": r"""SELECT d.doc_id AS work_id, trim(regexp_extract(text, '^[^.\n]*')) AS title, 'Author' || (d.doc_id % 97) || ', A.' AS authors,
  CASE WHEN d.doc_id % 11 <> 0 THEN CAST(1990 + d.doc_id % 35 AS INTEGER) END AS year, CASE WHEN d.doc_id % 3 = 0 THEN '10.1234/W' || (d.doc_id % 400) END AS doi,
  ['completed', 'pending', 'failed', 'skipped', 'processing'][d.doc_id % 5 + 1] AS status, CASE l.quality WHEN 1 THEN 5 WHEN 0 THEN 1 END AS quality,
  CAST(d.doc_id % 7 + 1 AS INTEGER) AS chapter, (d.doc_id % 7 + 1) || '.' || (d.doc_id % 12 + 1) AS section, ['high', 'medium', 'low'][d.doc_id % 3 + 1] AS priority,
  lang, source AS collection, text, CAST(toxic AS INTEGER) AS flagged FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "fragments": f"""SELECT l_orderkey * 8 + l_linenumber AS fragment_id, l_orderkey AS work_id, 'fragment ' || l_partkey || ' ' || l_suppkey AS text,
  CASE l_returnflag WHEN 'A' THEN 'quote' WHEN 'R' THEN 'summary' END AS kind, CAST(l_suppkey % 7 + 1 AS INTEGER) AS chapter,
  (l_suppkey % 7 + 1) || '.' || (l_partkey % 12 + 1) AS section, CAST(CAST(l_quantity AS INTEGER) % 5 + 1 AS INTEGER) AS relevance,
  CASE WHEN l_linenumber <> 7 THEN {_INTENT} END AS intent, l_shipdate AS added FROM lineitem""",
    "edges": f"SELECT l_orderkey AS citing, l_partkey AS cited, CAST(l_linenumber AS INTEGER) AS line, {_INTENT} AS intent FROM lineitem",
    "cited": "SELECT p_partkey AS cited, p_name || ' ' || p_partkey AS title, p_brand AS authors, CAST(1975 + p_size AS INTEGER) AS year, p_size <= 10 AS owned FROM part",
    "vectors": "SELECT vec_id AS id, label AS section, embedding AS v FROM embeddings",
    "usage": "SELECT event_id, ts AS seen, user_id, event_type AS operation, value AS amount, props FROM events",
}


def with_tables(sql: str) -> str:
    """Puts the common table expressions a statement needs before it."""
    import re

    used = [k for k in SQL if re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", sql)]
    head = ", ".join(f"{k} AS ({SQL[k]})" for k in used)
    body = sql.strip()
    if not head:
        return body
    if m := re.match(r"WITH (RECURSIVE )?", body, re.I):
        return f"WITH {m[1] or ''}{head}, {body[m.end():]}"
    return f"WITH {head} {body}"
