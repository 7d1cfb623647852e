import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from athenaeum.llm.pieces import MARKER, Pieces, decode, encode
from athenaeum.llm.trie import DoubleArray

PATH = __import__("public_tokenizers").path("piece_bpe_32k.model")


def field(number, payload, wire=2):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | wire)
    return head + (varint(payload) if wire == 0 else payload if wire == 5 else varint(len(payload)) + payload)


@pytest.fixture(scope="module")
def unigram():
    """The library itself, given the same pieces and scores as a Unigram model."""
    ours = Pieces.load(PATH)
    given = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = b""
    for i in range(given.get_piece_size()):
        kind = 2 if given.is_unknown(i) else 3 if given.is_control(i) else 6 if given.is_byte(i) else 1
        out += field(1, field(1, given.id_to_piece(i).encode()) + field(2, struct.pack("<f", ours.scores[i]), 5) + field(3, kind, 0))
    out += field(2, field(3, 1, 0) + field(35, 1, 0))
    out += field(3, field(1, b"identity") + field(3, 1, 0) + field(4, 0, 0) + field(5, 1, 0))
    return ours, sentencepiece.SentencePieceProcessor(model_proto=out)


def run(pieces, texts):
    ids, starts, scores = pieces.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])], scores, pieces.decode(ids, starts)


def test_equals_the_library_on_the_same_scores(unigram):
    ours, library = unigram
    words = "the of ation hello Straße élève ñandú 東京 😀 x1y2 !!! \t \n tion, (a) <b> 0.75 internationalization".split(" ")
    rng = random.Random(7)
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)] + ["東京ñandú" * 60, "a  b   c", " lead", "trail ", "\n\n", "é" * 40]
    got, _, back = run(ours, texts)
    assert got == [library.encode(t) for t in texts]
    assert [b.decode() for b in back] == texts


def test_edges(unigram):
    ours, _ = unigram
    got, scores, back = run(ours, ["", None, "a" * 50_000, "x y", "x y", f"a{MARKER}b"])
    assert got[0] == got[1] == [] and scores[0] == 0.0
    assert back[2] == b"a" * 50_000 and got[3] == got[4] and back[5] == b"a b"


def test_best_path_by_brute_force():
    rng = random.Random(1)
    alphabet = ["a", "b", "c"]
    named = {"".join(rng.choices(alphabet, k=rng.randint(1, 4))) for _ in range(25)} | {MARKER}
    table = [(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)] + [(p, -rng.random() * 5, "normal") for p in sorted(named)]
    ours = Pieces.of(table)
    score = {p.replace(MARKER, " "): s for p, s, k in table if k == "normal"}

    def best(s):
        top = [0.0] + [-1e9] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in score:
                    top[j] = max(top[j], top[i] + score[s[i:j]])
            if s[i] not in score:
                top[i + 1] = max(top[i + 1], top[i] + ours.unknown)
        return top[-1]

    texts = ["".join(rng.choices("abcd ", k=rng.randint(1, 14))) for _ in range(300)]
    _, scores, back = run(ours, texts)
    assert np.allclose(scores, [best(" " + t) for t in texts])
    assert [b.decode() for b in back] == texts


def test_double_array():
    keys = [(w.encode(), i) for i, w in enumerate(["a", "ab", "abc", "b", "ñ", "zz"])]
    trie = DoubleArray(keys)
    assert [trie.get(k) for k, _ in keys] == [i for _, i in keys] and trie.get(b"z") == trie.get(b"q") == -1


def test_long_texts_are_cut_before_words(unigram, monkeypatch):
    """What is solved together changes nothing, wherever it is cut."""
    ours, library = unigram
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "ation", "Straße", "", "東京", "x1y2!!", "\n"], k=rng.randint(0, 40))) for _ in range(60)] + ["", None, "東京ñandú" * 60]
    want = run(ours, texts)
    assert want[0] == [library.encode(t or "") for t in texts]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr("athenaeum.llm.pieces.SLICE", size)
        got = run(ours, texts)
        assert got[0] == want[0] and np.allclose(got[1], want[1]) and got[2] == want[2]


def test_a_text_of_a_hundred_megabytes_takes_less_than_a_gigabyte():
    import subprocess
    import sys

    code = f"""
import resource, sys
sys.path.insert(0, {str(__import__("pathlib").Path(__file__).parents[2])!r})
import pyarrow as pa
from athenaeum.llm.pieces import Pieces
ours = Pieces.load({PATH!r})
text = pa.array([" ".join("w%x" % (i * 2654435761 % 4294967296) for i in range(10_500_000))])
ids, starts, _ = ours.encode(text)
assert len(text[0].as_buffer()) > 95_000_000 and starts[-1] == len(ids) > 10_000_000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 1024 + 500  # 500: the list the text is made of


def test_encoding_and_decoding_frames(spark):
    rows = [(1, "the Straße 東京", "a"), (1, "the Straße 東京", "b"), (None, None, None), (2, "", "c"), (3, f"a{MARKER}b", "d"), (4, "  two  spaces ", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS ids", "1 AS score", "2 AS n_tokens")
    coded = encode(docs, PATH, ("doc_id", "lang"))
    got = {(r.doc_id, r.lang): r for r in coded.collect()}
    assert len(got) == 6 and got[(None, None)].n_tokens == 0 and {k[0]: r.lossless for k, r in got.items()} == {1: True, None: True, 2: True, 3: False, 4: True}
    back = {(r.doc_id, r.lang): r.text for r in decode(coded, PATH, ("doc_id", "lang")).collect()}
    assert back == {(i, k): (t or "").replace(MARKER, " ") for i, t, k in rows}
    assert encode(docs.limit(0), PATH).count() == 0 and decode(coded.limit(0), PATH).count() == 0


def test_ids_are_decoded_some_at_a_time(spark, monkeypatch):
    from athenaeum.llm import pieces
    from athenaeum.llm.queries import tokenizer_path

    monkeypatch.setattr(pieces, "SLICE", 8)
    model, texts = tokenizer_path("piece_bpe_32k.model"), [(i, t) for i, t in enumerate(["one two three four five", "", None, "ü ß " * 9, "x"])]
    coded = pieces.encode(spark.createDataFrame(texts, "doc_id long, text string"), model).unionByName(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>"), allowMissingColumns=True)
    assert {r.doc_id: r.text for r in pieces.decode(coded, model).collect()} == {i: t or "" for i, t in texts} | {9: ""}
