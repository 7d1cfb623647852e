"""Pieces the training-data operators share: staged tables and byte-level text access."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, and what a word is.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text an Arrow operator looks at together; bounds its working memory.
SLICE_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own where all run on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="athenaeum-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/athenaeum-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so that a lost executor costs no recomputation."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one value, so that their names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def rank(docs: DataFrame, *apart: str) -> Column:
    """A value that orders rows by all columns but those named; what has no order of its own is ordered as text."""
    some = [f for f in docs.schema if f.name not in apart]
    plain = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{f.name}`").alias(f"c{i}") if plain(f) else F.col(f"`{f.name}`").cast("string").alias(f"c{i}") for i, f in enumerate(some)])


def bind(value: Column, body) -> Column:
    """``let x = value in body(x)``: evaluates ``value`` once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sized_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text (a longer text is a run of its own)."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's start (one more at the end); a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array over ``data`` cut at ``starts`` (with the end as last)."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def distinct(items: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each item's index into the distinct items, and those."""
    coded = items.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)``."""
    total = int(lengths.sum())
    out = np.ones(total, dtype=np.int64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if not total:
        return out
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[first] = s - np.concatenate([[0], s[:-1] + n[:-1] - 1])
    return np.cumsum(out)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; what folds are cut by."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like :func:`sized_slices` over a whole partition: small batches are put together up to ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in sized_slices(batch, column, limit):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            if len(part):
                held.append(part)
                size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
