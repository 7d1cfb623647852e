"""Media columns: PNG in binary columns, and low-frequency cosine-transform hashes of it.

Images are written as a PNG file in memory: rows are filtered (none, left or up, whichever leaves the smallest residue),
deflated, cut into IDAT chunks, and every chunk gets its length and CRC-32. Reading tests signature, order, length and
checksum of every chunk, inflates, and takes the filters off with array operations (runs of rows of one kind at once; the
average and Paeth filters of foreign files row by row). The hash is the sign of each low-frequency coefficient of a 32 x 32
mean image's cosine transform against their median, 64 bits in a binary column.

Texts stand in for pixels: a text's UTF-8 bytes, filled with 255 to whole rows of ``WIDTH`` samples.

Defined results: null and empty texts are one row of 255; repeated rows are returned each; equal texts give equal bytes;
an empty table gives an empty result; extra columns are not carried. A text is one image, read and written whole: it takes some
six times its size in memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from athenaeum.llm.common import sized_slices

WIDTH = 576
CHUNK = 1 << 16
BAND = 4096
LEVEL = 6
#: The signature, and samples a pixel by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

SIDE, LOW = 32, 8
_COSINE = np.cos(np.pi * (2 * np.arange(SIDE) + 1)[None, :] * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(band: np.ndarray, above: np.ndarray) -> bytes:
    """Rows of samples, each behind the number of the filter that leaves the smallest residue; ``above``: the row before them."""
    height, width = band.shape
    left, up = band.copy(), band.copy()
    left[:, 1:] -= band[:, :-1]
    up[1:] -= band[:-1]
    up[0] -= above
    ways = (band, left, up)
    cost = np.stack([np.abs(w.view(np.int8).astype(np.int16)).sum(axis=1) for w in ways])
    kind = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), dtype=np.uint8)
    rows[:, 0] = kind
    for k, w in enumerate(ways):
        rows[kind == k, 1:] = w[kind == k]
    return rows.tobytes()


def encode_png(image: np.ndarray) -> bytes:
    """A PNG file of an 8-bit grey image (height, width). ``BAND`` rows are filtered and deflated at a time."""
    height, width = image.shape
    deflate, body, above = zlib.compressobj(LEVEL), [], np.zeros(width, dtype=np.uint8)
    for i in range(0, height, BAND):
        band = image[i : i + BAND]
        body.append(deflate.compress(_filtered(band, above)))
        above = band[-1]
    body = b"".join([*body, deflate.flush()])
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray, pixel: int) -> np.ndarray:
    """Takes the filters off in place; ``rows`` is (height, samples), ``pixel`` the samples between a sample and its left one."""
    height, width = rows.shape
    changes = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [height]])
    above = np.zeros(width, dtype=np.uint8)
    for a, b in zip(changes[:-1].tolist(), changes[1:].tolist(), strict=True):
        kind, part = int(kinds[a]), rows[a:b]
        if kind == 1:
            part.reshape(b - a, width // pixel, pixel)[:] = np.add.accumulate(part.reshape(b - a, width // pixel, pixel), axis=1, dtype=np.uint8)
        elif kind == 2:
            part[0] += above
            np.add.accumulate(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            for row in part:
                line, over = row.astype(int).tolist(), above.astype(int).tolist()
                for i in range(width):
                    left, corner = (line[i - pixel], over[i - pixel]) if i >= pixel else (0, 0)
                    if kind == 3:
                        guess = (left + over[i]) // 2
                    else:
                        by_left, by_up, by_corner = abs(over[i] - corner), abs(left - corner), abs(left + over[i] - 2 * corner)
                        guess = left if by_left <= by_up and by_left <= by_corner else over[i] if by_up <= by_corner else corner
                    line[i] = (line[i] + guess) & 255
                row[:] = line
                above = row
        elif kind:
            raise ValueError(f"unknown filter {kind}")
        above = rows[b - 1]
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height, width * channels) of an 8-bit PNG without interlace; ValueError for anything that fails a test."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data):
        if ended or at + 12 > len(data):
            raise ValueError("data outside of chunks")
        size, kind = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + size]
        if len(content) != size or at + 12 + size > len(data):
            raise ValueError("a chunk is cut short")
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("the header is not the one first chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or interlace or colour not in CHANNELS:
        raise ValueError("only plain 8-bit samples are read")
    across = width * CHANNELS[colour]
    raw = zlib.decompress(b"".join(body))
    if len(raw) != height * (across + 1):
        raise ValueError("the samples don't fill the image")
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(height, across + 1)
    return _unfilter(rows[:, 0], rows[:, 1:].copy(), CHANNELS[colour])


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits of a grey image's low frequencies."""
    height, width = image.shape

    def mean(values: np.ndarray, n: int) -> np.ndarray:
        # means over SIDE spans of the first axis, each one sample long at least
        a = np.arange(SIDE) * n // SIDE
        b = np.maximum(-(-(np.arange(1, SIDE + 1) * n) // SIDE), a + 1)
        if len(values) > BAND:  # spans of a long image are summed by themselves: whole numbers add up alike either way
            return np.array([values[i:j].sum(axis=0, dtype=np.float64) / (j - i) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
        return (sums[b] - sums[a]) / (b - a)[:, None]

    small = mean(mean(image, height).T, width).T
    low = np.round(_COSINE @ small @ _COSINE.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's length in bytes, and those filled to whole rows."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "text", 4 << 20):
            made = [payload(t) for t in part.column("text").to_pylist()]
            files = [encode_png(np.frombuffer(p, dtype=np.uint8).reshape(-1, WIDTH)) for _, p in made]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and its image as a PNG file in a binary column."""
    source = docs.select("doc_id", "text")
    return source.mapInArrow(_store, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "media", 4 << 20):
            images = [(decode_png(m), m) for m in part.column("media").to_pylist()]
            rows = [(x.size, hashlib.sha256(x.tobytes()).hexdigest(), zlib.crc32(x.tobytes()[-32:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(x)) for x, m in images]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])


def features(media: DataFrame) -> DataFrame:
    """Digests of stored images: of the samples read back, of the file, and the hash (binary)."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(_read, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")
