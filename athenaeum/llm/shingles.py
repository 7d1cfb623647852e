"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts are linked if their sets of ``SHINGLE``-word shingles (64-bit hashes) have a Jaccard similarity of ``LEAST`` or
more; the similarity is computed on the whole sets. Candidates meet in the groups of their SimHash fingerprints (``near``, made by
:mod:`athenaeum.llm.simhash`) and, as those differ in some 10 of 64 bits at similarity 0.8, also in ``BANDS`` bands of ``ROWS`` minima
each: a pair of similarity s meets in none of these with a chance of ``(1 - s**ROWS)**BANDS``, which is 5e-8 at 0.8 and less above.

Every member of a band's bucket is held against one pivot of the bucket first. Members of a bucket which that leaves in
different groups are then held against each other, so every pair that meets is either in one group or compared; a large
group of copies is done with after its pivot. That happens in blocks of some ``MEMBERS`` texts: all intersections of two blocks are
one product of matrices (shingles by texts), and what leaves a task is a link for each text at most, never the pairs.

Defined results: words are lower-cased (ASCII) and separated by white space; a text of fewer words than a shingle is one
shingle, null and empty texts are alike and linked to each other only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.llm.common import cut, rank, row, sized_slices
from athenaeum.llm.components import components

SHINGLE = 5
#: Similarity from which on texts are linked, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Shingles whose minima are taken at once.
CHUNK = 256
#: Hashes whose bits are counted at once.
VOTES = 1 << 16
#: Texts of a block, and numbers of a matrix of shingles by texts.
MEMBERS, CELLS = 128, 4 << 20

_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros_like(parts[0])
    for p in parts:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """The hash of the whole word sequence, and the text's distinct shingles in order."""
    words = (text or "").encode().lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words))
    if len(words) <= SHINGLE:
        return whole, np.array([whole] if words else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - SHINGLE + 1
    return whole, np.unique(_chained([hashed[i : i + n] for i in range(SHINGLE)]))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of the buckets that a set of shingles is dealt to."""
    if not len(found):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), CHUNK):
        least = np.minimum(least, (found[i : i + CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return _chained([np.arange(BANDS, dtype=np.uint64), *rows.T])


def voted(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of 64-bit hashes: a bit is set if it is in over half of them."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), VOTES):
        votes += np.unpackbits(hashes[i : i + VOTES].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ordered sets of shingles are similar enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "_text"):
            made = [shingles(t) for t in part.column("_text").to_pylist()]
            columns = [
                part.column("_id"), part.column("_hash"),
                pa.array(np.array([w for w, _ in made], dtype=np.uint64).view(np.int64)),
                pa.array([len(s) for _, s in made], pa.int64()),
                pa.array(np.array([voted(s) for _, s in made], dtype=np.uint64).view(np.int64)),
                pa.array([bands(s).view(np.int64) for _, s in made], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_hash", "key", "n", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "_text"):
            made = [shingles(t)[1].tobytes() for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(made, pa.binary())], names=["key", "set"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = lambda name: (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(name))  # noqa: B023, E731
        keep = pa.array([alike(x, y) for x, y in zip(of("x"), of("y"), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def intersections(tokens: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the first list has in common with each of the second (``tokens``: all sets' side by side, ``sizes``: of each)."""
    every, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    cuts = [inverse[: len(tokens[0])], inverse[len(tokens[0]) :]]
    of = [np.repeat(np.arange(len(n)), n) for n in sizes]
    out, step = np.zeros((len(sizes[0]), len(sizes[1])), dtype=np.float32), max(1, CELLS // max(1, *map(len, sizes)))
    for i in range(0, len(every), step):
        sides = []
        for at, who, n in zip(cuts, of, sizes, strict=True):
            some = (at >= i) & (at < i + step)
            m = np.zeros((min(step, len(every) - i), len(n)), dtype=np.float32)
            m[at[some] - i, who[some]] = 1
            sides.append(m)
        out += sides[0].T @ sides[1]
    return out.astype(np.int64)


def _links(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Links that join the groups of two blocks (keys, roots, sizes, tokens) as all similar pairs do, one for each two groups joined."""
    both = intersections([a[3], b[3]], [a[2], b[2]])
    alike = LEAST[1] * both >= LEAST[0] * (a[2][:, None] + b[2][None, :] - both)
    rows, columns = np.nonzero(alike & (a[1][:, None] != b[1][None, :]))
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        x, y = root(int(a[1][i])), root(int(b[1][j]))
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((int(a[0][i]), int(b[0][j])))
    return out


def _block(part: pa.Table) -> pa.Table:
    """One block: the links inside it, and if its bucket has more blocks a row with all of it."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part.column("set").to_pylist()]
    own = (part.column("key").to_numpy(), part.column("root").to_numpy(), np.array([len(x) for x in sets], dtype=np.int64), np.concatenate(sets))
    found = _links(own, own)
    whole = int(part.column("blocks")[0].as_py() > 1)
    n = len(found) + whole
    same = {k: pa.array([part.column(k)[0].as_py()] * n, t) for k, t in (("band", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()))}
    ends = {k: pa.array([x[i] for x in found] + [None] * whole, pa.int64()) for i, k in enumerate("ab")}
    held = {k: pa.array([None] * len(found) + [x.tobytes()] * whole, pa.binary()) for k, x in zip(("keys", "roots", "sizes", "tokens"), own, strict=True)}
    return pa.table(same | ends | held)


def _two_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"keys": np.int64, "roots": np.int64, "sizes": np.int64, "tokens": np.uint64}
    for batch in batches:
        for i in range(len(batch)):
            side = lambda tail: tuple(np.frombuffer(batch.column(k + tail)[i].as_buffer(), dtype=t) for k, t in kinds.items())  # noqa: B023, E731
            found = _links(side(""), side("_b"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _near_in_size(a: str, b: str):
    """What any two sets must be to reach the similarity."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def sketches(docs: DataFrame) -> DataFrame:
    """For every row its id (``_id``, null as the least long), its text's hash (``_hash``), key, number of shingles, fingerprint and buckets."""
    return cut(keyed(docs).select("_id", "_hash", "_text").mapInArrow(_sketched, "_id long, _hash long, key long, n long, fp long, bands array<long>"), "sketches")


def keyed(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as one value, its place among rows alike in id and text, the text and its hash, and the id with nulls made plain."""
    plain = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select(row(docs).alias("_row"), rank(docs, "doc_id", "text").alias("_rank"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"), plain.alias("_id"))


def groups(docs: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """(key, root) for every key of ``rows`` (the sketches of ``docs``) that is linked to another one; ``near`` (key, n, band) has buckets beside the rows' own."""
    first = F.struct("_id", "_hash")
    each = cut(rows.groupBy("key").agg(F.min(first).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")
    dealt = each.select("key", "n", F.explode("bands").alias("band")).union(near.select("key", "n", "band"))
    buckets = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("key", "band").alias("h"), "key", "n")).alias("p")).filter("m > 1")
    met = cut(dealt.join(buckets.select("band", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n")), "band"), "met")
    # the sets of all texts that meet another one; each is read from one of its rows
    wanted = met.select("key").distinct().join(each.select("key", "k._id", "k._hash"), "key")
    texts = keyed(docs).select("_id", "_hash", "_text").join(wanted, ["_id", "_hash"]).select("key", "_text")
    sets = cut(texts.mapInArrow(_sets, "key long, set binary").dropDuplicates(["key"]), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left, right = (sets.select(F.col("key").alias(k), F.col("set").alias(s)) for k, s in (("a", "x"), ("b", "y")))
        return cut(pairs.distinct().join(left, "a").join(right, "b").mapInArrow(_verified, "a long, b long"), name)

    pivots = met.filter(F.col("key") != F.col("pivot")).filter(_near_in_size("n", "pivot_n"))
    linked = verified(pivots.select(F.greatest("key", "pivot").alias("a"), F.least("key", "pivot").alias("b")), "pivots")
    found = components(linked).withColumnRenamed("node", "key")
    placed = met.select("band", "key").join(found, "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
    # buckets of two are done with; larger ones that hold several groups are looked into, block against block
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high and m > 2")
    parts = several.select("band", F.ceil(F.col("m") / MEMBERS).cast("int").alias("blocks"))
    dealt = placed.join(parts, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    fields = "band long, block int, blocks int, a long, b long, keys binary, roots binary, sizes binary, tokens binary"
    looked = cut(dealt.join(sets, "key").groupBy("band", "block").applyInArrow(_block, fields), "blocks")
    inner = looked.filter(F.col("keys").isNull()).select("a", "b")
    held = looked.filter(F.col("keys").isNotNull()).select("band", "block", "blocks", "keys", "roots", "sizes", "tokens")
    left = held.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).filter("block < other")
    right = held.select("band", F.col("block").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("keys", "roots", "sizes", "tokens")])
    outer = left.join(right, ["band", "other"]).mapInArrow(_two_blocks, "a long, b long")
    return components(linked.union(cut(inner.union(outer), "rest"))).withColumnRenamed("node", "key")
