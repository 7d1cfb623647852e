import zlib

import numpy as np
import pytest

from athenaeum.llm import records

PATH = __import__("public_tokenizers").path("byte_bpe_50k.json")
TEXTS = ["Hello, world! it's  fine\n\n next", "", None, "a  b 　c", "x" * 3000 + " end.", "<|endoftext|> don't 12,5% (a)b", "a <|endoftext|> b", "x<|endoftext|>", "élève, ñandú!  \t", "same", "same", " lead", "trail ", "\n", "a.b c..d 3.5e-7"]


def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in TEXTS]


def test_round_trip(spark):
    rows = [(i * 3 if i != 5 else None, t, "clash") for i, t in enumerate(TEXTS)]
    manifest = records.write(spark.createDataFrame(rows, "doc_id long, text string, start string"), PATH)
    got = sorted(map(tuple, records.read(manifest).collect()), key=lambda r: r[1])
    order = [5] + [i for i in range(len(TEXTS)) if i != 5]
    want, at = [], 0
    ids = expected()
    for i in order:
        want.append((rows[i][0], at, len(ids[i]), zlib.crc32(np.array(ids[i], dtype="<u4").tobytes())))
        at += len(ids[i])
    assert got == want
    line = manifest.orderBy("part").first()
    back = records.fetch(line["folder"], line["path"], list(range(line["records"]))[::-1])
    assert [b[1].tolist() for b in back] == [ids[i] for i in order[: line["records"]][::-1]]


def test_empty(spark):
    assert records.read(records.write(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


def test_damage_is_found():
    data = bytearray(records.frame(b"payload"))
    assert bytes(records.unframe(bytes(data), 0)[0]) == b"payload"
    assert records.unframe(bytes(data[:-1]), 0) is None
    for at in (2, 14):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def test_special_tokens_read_as_the_library_reads_them():
    encoder = records.Encoder(open(PATH, encoding="utf-8").read())
    ids, starts = encoder.encode(__import__("pyarrow").array(["a <|endoftext|> b"]))
    assert ids[starts[0] : starts[1]].tolist() == [64, 220, 50256, 275, 0]


def test_many_rows_of_one_id_and_one_very_long_text(spark):
    rows = [(None, f"t {i % 50}") for i in range(2000)] + [(7, "same")] * 500 + [(9, "long text " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS hash", "3 AS read").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = records.write(docs, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = records.read(manifest).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == [None] * 2000 + [7] * 500 + [9]
    assert manifest.count() > 2 and got[-1].n_tokens >= 600_000
