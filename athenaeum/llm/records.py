"""Token ids in length-delimited binary records.

A file is a run of frames: length (8 bytes), masked checksum of the length (4), payload, masked checksum of the payload
(4), all little-endian. A payload is the document's id (with a mark for null) and its token ids, two bytes each where
every id of the vocabulary fits, else four. Beside each file lies an index of fixed-size entries (offset, length, number
of ids, document id), so that shuffled readers can fetch any record by itself. The checksum is CRC-32 turned right by 15
bits plus a constant, so that a checksum stored inside checked data does no harm.

Documents are dealt to tasks by ranges of their id and sorted there, so files in order of their number hold ascending ids.
Files go to the folder that all machines share, under a temporary name until complete: a task that is run again writes the
same bytes and replaces the file. What comes back to the driver is one line for each file.

Byte-level BPE never joins characters across the start of a run of white space, nor a letter or digit to punctuation
after it, so texts are cut there and each distinct piece is encoded once per worker (a bounded cache); texts with other
Unicode spaces or with one of the tokenizer's added tokens are encoded whole. Special tokens in a text are read as the library
reads them by default.

Defined results: null and empty texts hold the end id alone; a null id comes first; repeated ids are records of their own, in
order of their texts' hashes (and dealt by them, so that many rows of one id, or without one, are no single task's); an empty
table writes no file; extra columns are not carried. A text is one record, made in memory: some ten times its size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.llm.common import SPACE, binaries, cut, ranges, sized_slices, stage_path, utf8

#: The mask's constant, and the frame's and the index entry's layout.
MASK = 0xA282EAD8
HEAD, TAIL, KEY, ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QIIBq")
END_ID = 0
CACHED = 1_000_000
READ = 8 << 20
#: Spaces beyond ASCII, which the tokenizer's pattern knows and the cutting rule doesn't.
OTHER_SPACE = "[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"

_ALNUM, _PUNCT = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
for _b in range(0x21, 0x7F):
    (_ALNUM if chr(_b).isalnum() else _PUNCT)[_b] = True


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int] | None:
    """The payload that starts at ``at`` and where the next frame does; None if it isn't all there."""
    view = memoryview(data)
    if at + HEAD.size > len(view):
        return None
    size, check = HEAD.unpack_from(view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise ValueError(f"the length at {at} fails its checksum")
    end = at + HEAD.size + size
    if end + TAIL.size > len(view):
        return None
    payload = view[at + HEAD.size : end]
    if masked(bytes(payload)) != TAIL.unpack_from(view, end)[0]:
        raise ValueError(f"the payload at {at} fails its checksum")
    return payload, end + TAIL.size


class Encoder:
    """A byte-level BPE tokenizer of the tokenizers library, over whole texts."""

    def __init__(self, spec: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        # a text that holds an added token is encoded whole: such tokens are found before anything is cut
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([OTHER_SPACE, *added])
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[bytes, bytes] = {}

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        cache = self.cache
        new = [p for p in parts if p not in cache]
        fresh: dict[bytes, bytes] = {}
        if new:
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = parts
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                for p, e in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, dtype=self.dtype).tobytes()
                    (cache if len(p) <= 64 else fresh)[p] = ids
        return [cache[p] if p in cache else fresh[p] for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each with the end id behind, and where each text's start."""
        texts = texts.fill_null("")
        data, offsets = utf8(texts)
        n = len(texts)
        if not len(data):
            return np.full(n, END_ID, dtype=self.dtype), np.arange(n + 1)
        space = SPACE[data]
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = space[1:] & ~space[:-1] | _PUNCT[data[1:]] & _ALNUM[data[:-1]]
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(whole):
            begins[offsets[i] : offsets[i + 1]] = False
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        coded = binaries(data, starts).dictionary_encode()
        inverse = coded.indices.to_numpy().astype(np.int64)
        found = self._ids(coded.dictionary.to_pylist())
        sizes = np.array([len(x) for x in found], dtype=np.int64) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), dtype=self.dtype)
        at = np.cumsum(sizes) - sizes
        each = sizes[inverse]
        ids = flat[ranges(at[inverse], each)]
        bounds = np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts[:-1], offsets)]
        out = np.full(len(ids) + n, END_ID, dtype=self.dtype)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
        return out, bounds + np.arange(n + 1)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One for each worker process, so that its cache outlives a task."""
    if hash(spec) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[hash(spec)] = Encoder(spec)
    return _ENCODERS[hash(spec)]


def _write(spec, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's file and index; gives the manifest's line."""
    encoder, task = _encoder(spec.value), TaskContext.get()
    part, out, index = task.partitionId(), None, None
    fs, root = pafs.FileSystem.from_uri(folder)
    name, mine = f"{root}/part-{part:06d}", f"{root}/_writing-{part:06d}-{task.taskAttemptId()}"
    at = records = tokens = 0
    for batch in batches:
        for piece in sized_slices(batch, "text"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out, index = fs.open_output_stream(f"{mine}.rec"), fs.open_output_stream(f"{mine}.idx")
            ids, starts = encoder.encode(piece.column("text"))
            frames, entries = [], []
            for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                null = doc_id is None
                made = frame(KEY.pack(null, doc_id or 0) + ids[a:b].tobytes())
                entries.append(ENTRY.pack(at, len(made), b - a, null, doc_id or 0))
                frames.append(made)
                at += len(made)
            out.write(b"".join(frames))
            index.write(b"".join(entries))
            records, tokens = records + len(frames), tokens + len(ids)
    if out is not None:
        out.close()
        index.close()
        for kind in ("rec", "idx"):
            fs.move(f"{mine}.{kind}", f"{name}.{kind}")
        made = [[part], [f"{name}.rec"], [records], [tokens], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["part", "path", "records", "tokens", "bytes"])


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Writes all rows of ``docs`` (doc_id, text); one line for each file: part, path, records, tokens, bytes, width."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec, folder = spark.sparkContext.broadcast(text), folder or stage_path(spark, "records")
    # rows alike in id and text differ in where they were read, which parts them and changes nothing else
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("read"))
    dealt = keyed.repartitionByRange("doc_id", "hash", "read").sortWithinPartitions("doc_id", "hash", "read").select("doc_id", "text")
    listed = cut(dealt.mapInArrow(lambda batches: _write(spec, folder, batches), "part long, path string, records long, tokens long, bytes long"), "manifest")
    return listed.withColumns({"folder": F.lit(folder), "width": F.lit(Encoder(text).dtype.itemsize)})


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads files in blocks from start to end, checks every frame, and digests its ids."""
    for batch in batches:
        for line in batch.to_pylist():
            fs, _ = pafs.FileSystem.from_uri(line["folder"])
            kind = np.dtype("<u2" if line["width"] == 2 else "<u4")
            start, rows, held = line["base"], [], b""
            with fs.open_input_file(line["path"]) as f:
                while True:
                    block = f.read(READ)
                    held, at = held + block, 0
                    while got := unframe(held, at):
                        payload, at = got
                        null, doc_id = KEY.unpack_from(payload)
                        ids = np.frombuffer(payload, dtype=kind, offset=KEY.size)
                        rows.append((None if null else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    held = held[at:]
                    if not block:
                        break
                    if len(rows) > 20_000:
                        yield _rows(rows)
                        rows = []
            if held or start != line["base"] + line["tokens"]:
                raise ValueError(f"{line['path']} is cut short")
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Every record: doc_id, start (ids before it in all files), n_tokens, crc32 of its ids as 32-bit numbers."""
    # one row for each file: the running total is over as many rows as there are files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    files = based.select("path", "folder", "width", "base", "tokens").repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(folder: str, path: str, places: list[int], width: int = 2) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their places, in the order asked for, through its index."""
    fs, _ = pafs.FileSystem.from_uri(folder)
    out = []
    with fs.open_input_file(path) as f, fs.open_input_file(path.removesuffix("rec") + "idx") as g:
        for place in places:
            offset, size, n, null, doc_id = ENTRY.unpack(g.read_at(ENTRY.size, place * ENTRY.size))
            payload, _ = unframe(f.read_at(size, offset), 0)
            ids = np.frombuffer(payload, dtype="<u2" if width == 2 else "<u4", offset=KEY.size)
            if len(ids) != n or KEY.unpack_from(payload) != (null, doc_id):
                raise ValueError(f"entry {place} of {path} doesn't fit its record")
            out.append((None if null else doc_id, ids))
    return out
