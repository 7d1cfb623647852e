"""SimHash near-duplicates over sharded BK-trees.

Fingerprints are 64 votes over the XXH64 of word shingles. Two fingerprints that differ in at most ``RADIUS`` bits agree in
one of ``RADIUS + 1`` blocks of bits, so distinct fingerprints are dealt into shards by (block, its value); every link
joins two members of a shard. A shard's fingerprints form a BK-tree (children keyed by their integer Hamming distance to
the parent), each fingerprint is searched along the edges within the radius only, and links inside a shard are folded
into a union-find, so that a shard of m fingerprints gives m links at most, not m squared.

All fingerprints would make a tree that grows with the corpus, so no tree is broadcast: shards meet their queries by key.
A shard of more than ``SPLIT`` fingerprints is dealt again, by block and value of its remaining bits (which still hold all
differences), so shards stay small at any size; what is broadcast for that is the list of such shards, at most
``(RADIUS + 1) * 2**16`` pairs of numbers whatever the input is.

Defined results: null or empty text has the zero fingerprint and is linked like any other; a document with a null id gets
the least id its group has, or null; repeated rows are returned each; an empty table gives an empty result; extra columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from athenaeum.llm import shingles
from athenaeum.llm.common import cut, sized_slices
from athenaeum.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCK = 16
SPLIT = 1024


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(whole, SEED)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    hashes = np.array([digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)], dtype=np.uint64)
    return shingles.voted(hashes)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [n for n in batch.schema.names if n != "text"]
        for part in sized_slices(batch, "text"):
            prints = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(prints)], names=[*keys, "fp"])


def fingerprints(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` and the fingerprint (as a signed long, ``fp``) of every row."""
    df = docs.select(*keys, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")
    return df.mapInArrow(_fingerprints, f"{fields}, fp long")


class BKTree:
    """Fingerprints with, under each, children keyed by their distance to it."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all members that differ in at most ``radius`` bits."""
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                if len(below) <= 2 * radius + 1:
                    todo += [c for k, c in below.items() if d - radius <= k <= d + radius]
                else:
                    todo += [below[k] for k in range(d - radius, d + radius + 1) if k in below]
        return found

    def add(self, value: int) -> int:
        place, at = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while place:
            below = self.children[at]
            d = (self.values[at] ^ value).bit_count()
            if d not in below:
                below[d] = place
                break
            at = below[d]
        return place


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (member, least member of its group) inside one shard, one for each member that isn't the least."""
    if len(members) == 2:
        a, b = members
        return [(max(a, b), min(a, b))] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius else []
    tree, up = BKTree(), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for m in members:
        bits = m & (2**64 - 1)
        near = tree.within(bits, radius)
        me = tree.add(bits)
        up.append(me)
        for i in near:
            a, b = root(i), root(me)
            if a != b:
                up[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, m in enumerate(members):
        r = root(i)
        least[r] = min(least.get(r, m), m)
    return [(m, least[root(i)]) for i, m in enumerate(members) if least[root(i)] != m]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard may run over several batches."""
    key: int | None = None
    members: list[int] = []
    out: list[tuple[int, int]] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out.clear()
        return made

    for batch in batches:
        for k, fp in zip(batch.column("shard").to_pylist(), batch.column("fp").to_pylist(), strict=True):
            if k != key:
                if len(members) > 1:
                    out += shard_links(members)
                key, members = k, []
            members.append(fp)
        if len(out) > 50_000:
            yield flush()
    if len(members) > 1:
        out += shard_links(members)
    yield flush()


def _dealt(fp: Column, width: int, bits: int, base: Column | None = None) -> Column:
    """Keys (base, block, the block's value) of one fingerprint's shards over its lowest ``bits``."""
    first = (lambda i: F.lit(i)) if base is None else (lambda i: base * (RADIUS + 1) + i)
    mask = (1 << width) - 1
    return F.array(*[F.shiftleft(first(i).cast("long"), width).bitwiseOR(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask))) for i in range(bits // width)])


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column ``fp``) within the radius."""
    keyed = prints.select("fp", F.explode(_dealt(F.col("fp"), BLOCK, 64)).alias("shard"))
    full = keyed.groupBy("shard").count().filter(F.col("count") > SPLIT).select(F.col("shard").alias("full"))
    marked = keyed.join(F.broadcast(full), F.col("shard") == F.col("full"), "left")
    # the other 48 bits, closed up: those above the shard's block move down over it
    low = (F.shiftright("shard", BLOCK) * BLOCK).cast("int")
    kept = F.expr(f"shiftleft(1L, cast(shiftright(shard, {BLOCK}) * {BLOCK} as int)) - 1")
    above = F.when(low == 64 - BLOCK, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(shiftrightunsigned(fp, cast(shiftright(shard, {BLOCK}) * {BLOCK} as int) + {BLOCK}), cast(shiftright(shard, {BLOCK}) * {BLOCK} as int))"))
    rest = F.col("fp").bitwiseAND(kept).bitwiseOR(above)
    narrow = (64 - BLOCK) // (RADIUS + 1)
    # shard numbers of the second deal lie above all of the first
    second = F.transform(_dealt(rest, narrow, 64 - BLOCK, F.col("shard")), lambda k: k + (1 << 40))
    shards = marked.select("fp", F.explode(F.when(F.col("full").isNull(), F.array("shard")).otherwise(second)).alias("shard"))
    by_shard = shards.repartition("shard").sortWithinPartitions("shard", "fp")
    return by_shard.mapInArrow(_shards, "a long, b long")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fingerprint that is linked to another one."""
    return components(links(prints)).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row, with the group's root fingerprint and the text's hash."""
    rows = cut(fingerprints(docs, F.col("doc_id"), F.xxhash64("text").alias("text_hash")), "fingerprints")
    each = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = groups(each.select("fp"))
    rooted = each.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    out = rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash")
    return out


def buckets(rows: DataFrame) -> DataFrame:
    """(key, n, band): the texts of sketches ``rows`` whose fingerprints the trees link, over any number of links, are in one bucket."""
    texts = cut(rows.filter("n > 0").select("key", "n", "fp").distinct(), "prints")
    placed = texts.join(groups(texts.select("fp").distinct()), "fp", "left")
    return cut(placed.select("key", "n", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("band")), "near")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Whole rows of ``docs``: of each group the one with the least id (null last; of its repeats the first by the text's hash, then by the other columns).

    Fingerprints of the sets of five-word shingles are linked as those of the query are; texts that they bring together are then
    held against each other, and are in one group from a similarity of 0.8 on. What three bits can't bring together meets by
    minima beside them (:mod:`athenaeum.llm.shingles`).
    """
    rows = shingles.sketches(docs)
    found = rows.join(shingles.groups(docs, rows, buckets(rows)), "key", "left").select("_id", "_hash", F.coalesce("root", "key").alias("root"))
    # the id with nulls made plain, which come last, and the text's hash; rows alike in both are told apart by their other columns below
    chosen = found.groupBy("root").agg(F.min(F.struct((F.col("_id") == -(2**63)).alias("n"), "_id", "_hash")).alias("k"))
    chosen = chosen.select(F.col("k._id").alias("_id"), F.col("k._hash").alias("_hash"))
    return shingles.keyed(docs).join(chosen, ["_id", "_hash"]).groupBy("_id", "_hash").agg(F.min_by("_row", "_rank").alias("_row")).select("_row.*")
