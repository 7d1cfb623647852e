"""Benchmark passages in documents, by Wu and Manber's search for many patterns.

A text is its words (letters, digits and all beyond ASCII, A-Z lower-cased) with one space between. A pattern is a window of ``WINDOW``
consecutive words of an item, or a shorter item as it is. Patterns are put into classes by length; of a class only the first
m bytes count, m being its shortest pattern. For each block of up to ``SPAN`` bytes at the end of m a shift table holds how
far a window can move without passing a place where some pattern could lie; where the shift is zero, the bucket of patterns
with the same suffix hash is compared, first by prefix, then byte by byte, and the bytes around are looked at for word ends.
A slice of texts is searched by many cursors at once, one for each ``LANE`` bytes, each moving by its own shifts.

Patterns are dealt into blocks of ``BLOCK_BYTES`` by the hash of pattern and item, and a block is what goes to the driver, is
broadcast and is searched for in all documents; a benchmark of several blocks is searched for block by block, what is found so
far travelling with the texts. Nothing depends on the number of rows, and no pattern and no occurrence is left out.

Defined results: null or wordless texts have no words and are never hit; texts longer than a slice are read piece by piece, with as
much of the last piece before the next as the longest pattern takes (a single longer word is read whole, at some twelve times its bytes of memory);
alike windows of several items name all of them; repeated item ids are one item; items without an id hit words but are not
named; repeated documents are found each; an empty benchmark finds nothing; columns beyond those named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from athenaeum.llm.common import LOWER, cut, drop, gathered, ranges, utf8

#: Words of a window, and what a word is made of.
WINDOW = 10
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[:0x80] = False
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: Bytes of a block of the shift table, of a cursor's part of the text, of one piece of a long text, and of patterns that are searched for together.
SPAN, LANE, PIECE, BLOCK_BYTES = 8, 4096, 8 << 20, 8 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(items: DataFrame) -> DataFrame:
    """(pattern, words, item_id as text): the distinct windows of every item."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORDS), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)))
    each = items.select(F.col("item_id").cast("string").alias("item_id"), words.alias("words")).filter(F.size("words") > 0)
    runs = each.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("run"))
    return runs.select(F.array_join("run", " ").alias("pattern"), F.size("run").alias("words"), "item_id").distinct()


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends in eight bytes to spare."""
    return np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def _first(n: int | np.ndarray) -> np.ndarray:
    """What keeps the first ``n`` bytes (at most eight) of a number of eight."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(n, 8).astype(np.uint64))


class Class(NamedTuple):
    """Patterns of like length: how many bytes count, the shift of each block's hash, and the patterns in order of their suffix hash."""

    m: int
    span: int
    bits: int
    shifts: np.ndarray
    hashes: np.ndarray
    members: np.ndarray


class Searcher:
    """The tables for one block of patterns."""

    def __init__(self, patterns: list[bytes], words: list[int], items: list[list[str | None]]) -> None:
        lengths = np.array([len(p) for p in patterns], dtype=np.int64)
        self.lengths, self.words, self.items = lengths, np.array(words, dtype=np.int64), items
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.data = _padded(np.frombuffer(b"".join(patterns), dtype=np.uint8))
        self.longest = int(lengths.max(initial=0))
        size = np.maximum(np.frexp(lengths.astype(float))[1], 3) if len(patterns) else lengths
        self.classes = [self._class(np.flatnonzero(size == k)) for k in np.unique(size)]

    def _class(self, members: np.ndarray) -> Class:
        m = int(self.lengths[members].min())
        span = min(SPAN, m)
        places = m - span + 1
        bits = int(np.clip(np.ceil(np.log2(len(members) * places)) + 3, 12, 24))
        at = np.arange(places)
        shifts = np.full(1 << bits, places, dtype=np.uint32)
        for part in np.array_split(members, max(1, len(members) * places >> 20)):
            keys = self._hash(_eights(self.data)[self.starts[part][:, None] + at], span, bits)
            np.minimum.at(shifts, keys.ravel(), np.broadcast_to(places - 1 - at, keys.shape).ravel().astype(np.uint32))
        suffix = self._hash(_eights(self.data)[self.starts[members] + m - span], span, bits)
        order = np.argsort(suffix, kind="stable")
        return Class(m, span, bits, shifts, suffix[order], members[order])

    @staticmethod
    def _hash(eight: np.ndarray, span: int, bits: int) -> np.ndarray:
        return ((eight & _first(np.array(span))) * MIX >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of all occurrences in a text of words and spaces, which begins and ends with other than a word and has eight bytes to spare."""
        eights, found = _eights(text), []
        for c in self.classes:
            last = len(text) - 8 - c.m
            at = np.arange(0, last + 1, LANE, dtype=np.int64)
            stop = np.minimum(at + LANE, last + 1)
            while len(at):
                key = self._hash(eights[at + c.m - c.span], c.span, c.bits)
                shift = c.shifts[key]
                here = shift == 0
                if here.any():
                    found.append(self._compared(c, text, eights, at[here], key[here]))
                at = at + np.maximum(shift, 1)
                alive = at < stop
                at, stop = at[alive], stop[alive]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _compared(self, c: Class, text: np.ndarray, eights: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which patterns of the places' buckets stand there."""
        low, high = np.searchsorted(c.hashes, key, side="left"), np.searchsorted(c.hashes, key, side="right")
        at, which = np.repeat(at, high - low), c.members[ranges(low, high - low)]
        own, done, out = _eights(self.data), 0, []
        while len(at):
            unlike = (eights[at + done] ^ own[self.starts[which] + done]) & _first(self.lengths[which] - done)
            at, which = at[unlike == 0], which[unlike == 0]
            done += SPAN
            whole = self.lengths[which] <= done
            out.append((at[whole], which[whole]))
            room = ~whole & (at + self.lengths[which] <= len(text) - 8)
            at, which = at[room], which[room]
        at, which = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in (0, 1))
        apart = ~IN_WORD[text[at - 1]] & ~IN_WORD[text[at + self.lengths[which]]]
        return at[apart], which[apart]


def tidied(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts (cut at ``ends``) as words with one space between; a zero byte comes before the first and after each."""
    text = LOWER[np.insert(np.concatenate([[np.uint8(0)], raw]), ends + 1, 0)]
    bounds = np.concatenate([[0], ends + 1 + np.arange(len(ends))])
    word = IN_WORD[text]
    keep = word.copy()
    keep[1:] |= word[:-1]
    text[~word] = 0x20
    text[bounds] = 0
    keep[bounds] = True
    return text[keep]


class Found(NamedTuple):
    """Of a run of texts: words of each, and occurrences as (row, first word, last word + 1, pattern)."""

    n_words: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    pattern: np.ndarray


def _found(searcher: Searcher, text: np.ndarray) -> Found:
    """Occurrences in tidied texts."""
    word = IN_WORD[text]
    heads = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    bounds = np.flatnonzero(text == 0)
    before = np.searchsorted(heads, bounds)
    at, which = searcher.find(_padded(text))
    row = np.searchsorted(bounds, at) - 1
    first = np.searchsorted(heads, at) - before[row]
    return Found(np.diff(before), row, first, first + searcher.words[which], which)


def _found_in_long(searcher: Searcher, raw: np.ndarray) -> Found:
    """The same for one long text, piece by piece; each begins with the end of the one before, so what lies across is found."""
    parts, at, seen, tail = [], 0, 0, np.zeros(0, dtype=np.uint8)
    while at < len(raw):
        to = min(at + PIECE, len(raw))
        while to < len(raw) and IN_WORD[LOWER[raw[to - 1]]]:
            gap = np.flatnonzero(~IN_WORD[LOWER[raw[to : to + PIECE]]])
            to = to + int(gap[0]) + 1 if len(gap) else min(to + PIECE, len(raw))
        piece = tidied(raw[at:to], np.array([to - at]))
        text = np.concatenate([[np.uint8(0)], tail, piece[1:]])
        found = _found(searcher, text)
        behind = int((IN_WORD[tail] & ~IN_WORD[np.concatenate([[np.uint8(0)], tail[:-1]])]).sum()) if len(tail) else 0
        parts.append(found._replace(first=found.first + seen - behind, last=found.last + seen - behind))
        seen += int(found.n_words.sum()) - behind
        rest = text[1:-1]
        cuts = np.flatnonzero(~IN_WORD[rest[: max(0, len(rest) - searcher.longest - 1)]])
        tail = rest[cuts[-1] + 1 :] if len(cuts) else rest
        at = to
    return Found(np.array([seen]), *(np.concatenate([p[i] for p in parts]) for i in range(1, 5)))


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans of words, row by row, in order."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    if not len(row):
        return row, first, last
    room = int(last.max()) + 1
    reach = np.maximum.accumulate(row * room + last)
    new = np.concatenate([[True], row[1:] * room + first[1:] > reach[:-1]]) | np.concatenate([[True], row[1:] != row[:-1]])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(row)]]) - 1
    return row[starts], first[starts], reach[ends] - row[starts] * room


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _lists(rows: np.ndarray, values: pa.Array, n: int, kind: pa.DataType) -> pa.Array:
    """``values``, which belong to ascending ``rows``, as one list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values).cast(kind)


def _searched(batch: pa.RecordBatch, searcher: Searcher) -> dict[str, pa.Array]:
    n, (raw, starts) = len(batch), utf8(batch.column("text"))
    found = _found_in_long(searcher, raw) if n == 1 and len(raw) > PIECE else _found(searcher, tidied(raw, starts[1:]))
    spans, named = batch.column("spans"), batch.column("items")
    old = [np.repeat(np.arange(n), np.diff(np.asarray(spans.offsets))), *(spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))]
    row, first, last = _merged(*(np.concatenate([a, b]).astype(np.int64) for a, b in zip(old, (found.row, found.first, found.last), strict=True)))
    pairs = np.unique(np.stack([found.row, found.pattern]), axis=1)
    items = [set(x) for x in named.to_pylist()]
    for r, p in pairs.T.tolist():
        items[r].update(i for i in searcher.items[p] if i is not None)
    return {
        "n_words": pa.array(found.n_words, pa.int64()),
        "spans": _lists(row, pa.StructArray.from_arrays([pa.array(first), pa.array(last)], ["start", "end"]), n, SPANS),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    }


def _table(patterns: DataFrame, k: int, n: int) -> Searcher:
    """The tables of block ``k`` of ``n`` of the patterns."""
    part = patterns.filter(F.pmod(F.xxhash64("pattern", "item_id"), F.lit(n)) == k)
    by: dict[str, tuple[int, list[str | None]]] = {}
    for pattern, words, item in part.select("pattern", "words", "item_id").toLocalIterator():
        by.setdefault(pattern, (words, []))[1].append(item)
    return Searcher([p.encode() for p in by], [w for w, _ in by.values()], [i for _, i in by.values()])


def _search(state: DataFrame, searcher: Searcher, last: bool) -> DataFrame:
    """What ``state`` has found, and what the tables find besides; texts go along unless this is the last time."""
    sent = state.sparkSession.sparkContext.broadcast(searcher)
    kept = [f for f in state.schema if f.name != "text" or not last]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", PIECE):
            made = _searched(batch, sent.value)
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else batch.column(f.name) for f in kept], [f.name for f in kept])

    return state.mapInArrow(search, StructType(kept))


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, spans, items) of every row: its words, the spans of words that windows cover, and the items they are of, in order."""
    patterns = cut(windows(items), "windows")
    size = F.octet_length("pattern") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16
    n = -(-(patterns.agg(F.sum(size)).first()[0] or 1) // BLOCK_BYTES)
    none = [F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items")]
    state = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("n_words"), *none)
    read = None
    for k in range(n):
        if k:
            state = cut(state, "searched")
            if read is not None:
                drop(read)
            read = state
        state = _search(state, _table(patterns, k, n), k == n - 1)
    return state.select(F.col("key").alias(key), "n_words", "spans", "items")


def hits(spans: Column) -> Column:
    """Words that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The figures of each row."""
    n_hit = hits(F.col("spans"))
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
