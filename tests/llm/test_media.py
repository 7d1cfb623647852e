import math
import hashlib
import struct
import zlib

import numpy as np
import pytest

from athenaeum.llm import media


def test_round_trip_and_damage():
    rng = np.random.default_rng(3)
    for shape in ((1, 576), (7, 576), (200, 576), (3, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        image[: shape[0] // 2] = 7
        data = media.encode_png(image)
        assert (media.decode_png(data) == image).all()
        for at in (3, 20, len(data) // 2, len(data) - 2):
            bad = bytearray(data)
            bad[at] ^= 4
            with pytest.raises((ValueError, zlib.error)):
                media.decode_png(bytes(bad))
        for short in (data[:-12], data[:40], b""):
            with pytest.raises(ValueError):
                media.decode_png(short)


def test_all_filters_and_channels():
    """Rows filtered here by the format's rules, one after another, with each of the five filters."""
    rng = np.random.default_rng(5)
    for colour, channels in ((0, 1), (2, 3)):
        image = rng.integers(0, 256, (15, 8 * channels), dtype=np.uint8).astype(int)
        raw = b""
        for y, row in enumerate(image):
            above = image[y - 1] if y else np.zeros_like(row)
            out = []
            for x, v in enumerate(row):
                a, b, c = (row[x - channels] if x >= channels else 0), above[x], (above[x - channels] if x >= channels else 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, near)[y % 5]) % 256)
            raw += bytes([y % 5, *out])
        body = zlib.compress(raw)
        head = struct.pack(">IIBBBBB", 8, 15, 8, colour, 0, 0, 0)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        data = media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body[:9]) + chunk(b"IDAT", body[9:]) + chunk(b"IEND", b"")
        assert (media.decode_png(data) == image).all()


def test_hash_is_robust():
    rng = np.random.default_rng(1)
    image = (128 + 100 * np.sin(np.arange(64)[:, None] / 9) * np.cos(np.arange(576)[None, :] / 60)).astype(np.uint8)
    noisy = np.clip(image + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, image.shape, dtype=np.uint8)
    bits = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    assert bits(media.cosine_hash(image), media.cosine_hash(noisy)) <= 8 < bits(media.cosine_hash(image), media.cosine_hash(other))


def test_operator(spark):
    texts = ["", None, "añb" * 500, "same", "same", "x" * 576, "y" * 577]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in media.features(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        n, data = media.payload(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
    assert got[3].hash == got[4].hash and got[0].media_sha256 == got[1].media_sha256
    assert media.features(media.store(docs.limit(0))).count() == 0


def test_hash_equals_brute_force():
    """Means, the cosine transform and the median, term by term."""
    rng = np.random.default_rng(4)
    for height, width in ((1, 576), (7, 576), (100, 64), (33, 31)):
        image = rng.integers(0, 256, (height, width), dtype=np.uint8)
        span = lambda i, n: range(i * n // 32, max(-(-(i + 1) * n // 32), i * n // 32 + 1))
        small = [[sum(float(image[y, x]) for y in span(i, height) for x in span(j, width)) / (len(span(i, height)) * len(span(j, width))) for j in range(32)] for i in range(32)]
        low = [[sum(small[y][x] * math.cos(math.pi * (2 * y + 1) * u / 64) * math.cos(math.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
        flat = [round(c, 6) for row in low for c in row]
        middle = sorted(flat[1:])[31]
        want = "".join("1" if c > middle else "0" for c in flat)
        assert int.from_bytes(media.cosine_hash(image), "big") == int(want, 2)


def test_bands_are_one_image(monkeypatch):
    image = np.random.default_rng(1).integers(0, 9, (50, 576), dtype=np.uint8)
    whole = media.encode_png(image)
    for band in (1, 7, 49):
        monkeypatch.setattr(media, "BAND", band)
        made = media.encode_png(image)
        assert made == whole and (media.decode_png(made) == image).all()


def test_one_very_long_text_and_columns_of_inner_names(spark):
    docs = spark.createDataFrame([(1, "long text é " * 400_000), (None, None), (2, "x"), (2, "x")], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes", "3 AS hash")
    got = {r.doc_id: r for r in media.features(media.store(docs)).collect()}
    assert got[1].n_bytes == 13 * 400_000 and got[1].payload_bytes % 576 == 0 and got[None].n_bytes == 0 and got[2].payload_bytes == 576
