"""From raw documents to token ids: quality, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor left; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them again, so that a lost executor never
costs more than the stage at hand.

The pseudonyms are keyed by the session's setting ``spark.athenaeum.pii.secret``, whose name makes Spark leave its value out of logs.
Where it is unset a key is drawn by chance for the application and kept in no setting, so that nobody can turn them back; set it to
link runs with each other.

Defined results: see the operators; repeated ids are kept apart by their texts, columns of any name pass through the stages up
to the last, and an empty table stays empty throughout.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athenaeum.llm import mixing, pieces, pii, quality, simhash
from athenaeum.llm.common import cut, documents, drop
from athenaeum.llm.queries import tokenizer_path
from athenaeum.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def pii_key(spark: SparkSession) -> bytes:
    """The pseudonyms' key, drawn once for an application that gives none."""
    context = spark.sparkContext
    if given := spark.conf.get("spark.athenaeum.pii.secret", ""):
        return given.encode()
    if not hasattr(context, "_athenaeum_pii_key"):
        context._athenaeum_pii_key = secrets.token_bytes(32)
    return context._athenaeum_pii_key


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts of characters follow the new texts (all pseudonyms but network addresses keep their length)."""
    ship(spark)
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    made = pii.pseudonymize(docs.select(others.alias("row"), "text"), pii_key(spark))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", pseudonyms),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: SimHash, the pseudonyms, the mix and the encoding are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return docs
