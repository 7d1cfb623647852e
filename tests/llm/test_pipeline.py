import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

import corpus_pipeline
from athenaeum.llm import queries
from athenaeum.llm.common import cut, documents
from athenaeum.llm.pieces import Pieces
from athenaeum.llm.pii import Pseudonyms

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs, columns = documents(spark, DATA), documents(spark, DATA).columns
    rows = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        rows[i] = docs.collect()
        if i < 4:
            assert docs.columns == columns, name
    whole = {r.doc_id: r for r in documents(spark, DATA).collect()}
    assert 0 < len(rows[0]) < len(whole) and all(whole[r.doc_id] == r for r in rows[0])
    assert all(len(r.text.split()) >= 20 for r in rows[0])
    # no text stays twice, and what went is near something that stayed or is a copy of it
    texts = Counter(r.text for r in rows[1])
    assert max(texts.values()) == 1 and {r.text for r in rows[0]} >= set(texts)
    names = Pseudonyms(corpus_pipeline.pii_key(spark))
    assert {r.doc_id: r.text for r in rows[2]} == {r.doc_id: names.replace(r.text)[0] for r in rows[1]}
    times = Counter(r.doc_id for r in rows[3])
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows[2]}
    assert set(times) <= set(size) and max(times.values()) <= 2
    taken = sum(size[i] * n for i, n in times.items())
    assert abs(taken / (1.5 * sum(size.values())) - 1) < 0.05
    pieces = Pieces.load(queries.tokenizer_path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in rows[3]}
    for r in rows[4][:20]:
        ids, starts, _ = pieces.encode(pa.array([text[r.doc_id]]))
        assert r.ids == ids.tolist() and pieces.decode(np.array(r.ids), np.array([0, len(r.ids)]))[0].decode() == text[r.doc_id]
    assert Counter(r.doc_id for r in rows[4]) == times and all(r.lossless for r in rows[4])


def test_empty(spark):
    docs = documents(spark, DATA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_odd_rows(spark):
    """Nulls, repeats, ties, columns of inner names and one very long text, through all stages."""
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(i, text(i) + " mail me: a.b@example.com", "en", f"s{i % 3}") for i in range(30)]
    rows += [rows[0], rows[0], (0, rows[0][1], "de", "s0"), (None, text("n"), None, None), (None, text("n"), "fr", None), (40, None, "en", "s1"), (41, "", None, "s1"), (42, text("long", 200_000), "en", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    odd = docs.selectExpr("*", *(f"concat('{c}', coalesce(lang, '')) AS {c}" for c in ("_id", "_hash", "_row", "row", "key", "pii_count", "kept", "n_words", "size", "mark", "ids", "host")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns, odd = odd.columns, cut(stage(spark, odd, DATA), "odd")
        assert odd.columns == columns, name
        found = odd.collect()
        assert all(r.pii_count == f"pii_count{r.lang or ''}" and r.n_chars == len(r.text) for r in found), name
        ids = Counter(r.doc_id for r in found)
        if name == "near duplicates":
            assert set(ids.values()) == {1} and {r.doc_id: r.lang for r in found} == {i: "en" for i in range(30)} | {0: "de", None: None, 42: "en"}
    out = corpus_pipeline.STAGES[4][1](spark, odd, DATA).collect()
    assert len(out) == len(found) and all(r.lossless for r in out)
