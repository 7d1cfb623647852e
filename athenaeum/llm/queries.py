"""The training-data operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athenaeum.llm import manifest, media, mixing, ngrams, passages, pieces, pii, preference, quality, records, simhash, talks, toxicity
from athenaeum.llm.common import cut, documents


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def decoded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other way of op1: the texts that its ids spell."""
    model = tokenizer_path("piece_bpe_32k.model")
    return pieces.decode(pieces.encode(documents(spark, sf_dir), model), model)


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gathered = cut(preference.gather(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "gathered")
    made = preference.format_pairs(gathered, preference.pair_by_opening(gathered))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return made.withColumns({"chosen_spans": text("chosen_spans"), "rejected_spans": text("rejected_spans")})


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), staged=lambda df: cut(df, "judged"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Keys the pseudonyms of the registered queries; a deployment passes its own.
PII_KEY = b"a key for tests"


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir), PII_KEY).select("doc_id", "text", "pii_count", "pii_spans")


def op6_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(documents(spark, sf_dir))


def op8_length_delimited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.read(records.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op9_png_cosine_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media.store(documents(spark, sf_dir)), "media")
    return media.features(stored).withColumn("feature", F.lower(F.hex("hash"))).drop("hash")


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_wu_manber_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.contaminated(passages.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(manifest.manifest(documents(spark, sf_dir)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece_unigram,
        op2_preference_pairs,
        op3_simhash_near_duplicates,
        op4_host_quality_rules,
        op5_feistel_pseudonyms,
        op6_levenshtein_lexicon,
        op7_backoff_automaton,
        op8_length_delimited_records,
        op9_png_cosine_hash,
        op10_entropy_mix,
        op11_wu_manber_contamination,
        op12_merkle_manifest,
        op13_prefix_trie,
        decoded_pieces,
    )
}


def crc_sql(number: str) -> str:
    """crc32 of a number's decimal digits, bit by bit."""
    byte = "list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda c, b: {byte}, 4294967295), 4294967295)"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Levels that the manifest's SQL unrolls (enough for 8 ** 8 leaves).
HEIGHT = 8


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str) -> str:
    """The levels of trees that begin with {name}_0 (tree, pos, node): every node with what stands beside it, and the roots."""
    out = []
    for i in range(HEIGHT):
        out.append(f"{name}_c{i} AS (SELECT tree, count(*) AS n FROM {name}_{i} GROUP BY tree)")
        out.append(f"{name}_r{i} AS (SELECT tree, pos // 8 AS run, list(node ORDER BY pos) AS nodes, n FROM {name}_{i} JOIN {name}_c{i} USING (tree) GROUP BY tree, pos // 8, n)")
        out.append(f"{name}_{i + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node FROM {name}_r{i})")
    return ",\n".join(out)


def _climb_sql(name: str, below: str, made: str) -> str:
    """{below} (id, tree, pos, proof, folded) taken up to the root of its tree, level by level."""
    out = [f"{made}_0 AS ({below})"]
    for i in range(HEIGHT):
        left, right = "array_to_string(nodes[1:pos % 8], '')", "array_to_string(nodes[pos % 8 + 2:], '')"
        out.append(
            f"{made}_{i + 1} AS (SELECT id, u.tree, pos // 8 AS pos, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
            f"CASE WHEN n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded FROM {made}_{i} u JOIN {name}_r{i} r ON r.tree = u.tree AND r.run = u.pos // 8)"
        )
    return ",\n".join(out)


MANIFEST_SQL = f"""
WITH l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
             CASE WHEN {crc_sql("doc_id")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM l),
a_0 AS (SELECT tree, pos, leaf AS node FROM p),
{_tree_sql("a")},
b_0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, tree AS lang FROM a_{HEIGHT}),
{_tree_sql("b")},
{_climb_sql("a", "SELECT id, tree, pos, '' AS proof, coalesce(changed, leaf) AS folded FROM p", "x")},
{_climb_sql("b", f"SELECT id, '' AS tree, b_0.pos, proof, folded FROM x_{HEIGHT} x JOIN b_0 ON b_0.lang = x.tree", "y")}
SELECT p.doc_id, p.leaf, b_0.node AS subroot, t.node AS root, sha256(y.proof) AS proof_sha256, y.folded AS folded_root, y.folded = t.node AS verified
FROM p JOIN y_{HEIGHT} y USING (id) JOIN b_0 ON b_0.lang = p.tree CROSS JOIN b_{HEIGHT} t
"""

TRIE_SQL = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
             strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, '') AS said, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc_sql("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, pos, said, bytes FROM c JOIN o ON o.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, said, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, bytes, sha256(string_agg(sha256(said), '') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
s AS (SELECT * FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM s GROUP BY depth, node),
u AS (SELECT n.depth, n.node, n.conv_id, n.n_convs, n.bytes, up.conv_id AS parent_conv_id, up.node AS parent FROM n
      LEFT JOIN s ON s.conv_id = n.conv_id AND s.depth = n.depth - 1 LEFT JOIN n up ON up.depth = s.depth AND up.node = s.node),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (depth, node)),
t AS (SELECT s.depth, s.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens
      FROM v JOIN s ON s.conv_id = v.conv_id AND s.depth <= v.depth GROUP BY s.depth, s.node),
e AS (SELECT depth, node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM s GROUP BY conv_id) GROUP BY depth, node)
SELECT v.conv_id, v.depth, v.parent_conv_id, v.n_convs, v.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v JOIN t USING (depth, node) LEFT JOIN e USING (depth, node)
"""

ORACLE_SQL = {
    "op11_wu_manber_contamination": rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: ws[i:i + 9])) AS win FROM b WHERE len(ws) > 0),
d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT DISTINCT len(win) AS n FROM p),
w AS (SELECT id, n, unnest(range(1, len(ws) - n + 2)) AS pos, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1])) AS win FROM d JOIN n ON len(ws) >= n),
h AS (SELECT w.id, w.pos, w.n, p.item_id FROM w JOIN p ON p.win = w.win),
x AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(pos, pos + n)) AS place FROM (SELECT DISTINCT id, pos, n FROM h)) GROUP BY id),
i AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT id, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (id) LEFT JOIN i USING (id)
""",
    "op12_merkle_manifest": MANIFEST_SQL,
    "op13_prefix_trie": TRIE_SQL,
    "decoded_pieces": "SELECT doc_id, replace(coalesce(text, ''), '▁', ' ') AS text FROM documents",
    "op2_preference_pairs": r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS made, length(role) + 5 AS head FROM t),
v AS (SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS n, floor(conv_id / 128.0) AS block, arg_min(role, pos) AS role1, arg_min(text, pos) AS text1 FROM t GROUP BY conv_id),
u AS (SELECT *, row_number() OVER (PARTITION BY role1, text1, block ORDER BY conv_id) - 1 AS place, count(*) OVER (PARTITION BY role1, text1, block) AS many FROM v),
w AS (SELECT conv_id, n, CASE WHEN place < many - many % 2 THEN (role1, text1, block, place // 2) ELSE ('', '', -1.0, CAST(floor(conv_id / 2.0) AS BIGINT)) END AS pair, place < many - many % 2 AS alike FROM u),
p AS (SELECT arg_max(conv_id, (n, -conv_id)) AS chosen_id, arg_min(conv_id, (n, -conv_id)) AS rejected_id FROM w GROUP BY alike, pair HAVING count(*) = 2),
d AS (SELECT p.chosen_id, p.rejected_id, a.pos FROM p JOIN r a ON a.conv_id = p.chosen_id
      LEFT JOIN r b ON b.conv_id = p.rejected_id AND b.pos = a.pos WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text),
z AS (SELECT conv_id, max(pos) AS last FROM r GROUP BY conv_id),
n AS (SELECT p.chosen_id, p.rejected_id, coalesce(min(d.pos) - 1, min(c.last)) AS n_common
      FROM p JOIN z c ON c.conv_id = p.chosen_id LEFT JOIN d ON d.chosen_id = p.chosen_id GROUP BY p.chosen_id, p.rejected_id),
s AS (SELECT n.*, r.*, sum(length(made)) OVER (PARTITION BY n.chosen_id, r.conv_id, r.pos > n_common ORDER BY r.pos) AS upto
      FROM n JOIN r ON r.conv_id IN (n.chosen_id, n.rejected_id))
SELECT chosen_id, rejected_id, n_common,
       coalesce(string_agg(made, '' ORDER BY pos) FILTER (WHERE conv_id = chosen_id AND pos <= n_common), '') AS prompt,
       coalesce(string_agg(made, '' ORDER BY pos) FILTER (WHERE conv_id = chosen_id AND pos > n_common), '') AS chosen,
       coalesce(string_agg(made, '' ORDER BY pos) FILTER (WHERE conv_id = rejected_id AND pos > n_common), '') AS rejected,
       coalesce(string_agg((upto - length(made) + head) || '-' || upto, ',' ORDER BY pos) FILTER (WHERE conv_id = chosen_id AND pos > n_common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((upto - length(made) + head) || '-' || upto, ',' ORDER BY pos) FILTER (WHERE conv_id = rejected_id AND pos > n_common AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY chosen_id, rejected_id, n_common
""",
    "op4_host_quality_rules": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
v AS (SELECT doc_id, pos,
             CASE WHEN lead(word, 7) OVER p IS NOT NULL THEN
               concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p,
                         lead(word, 5) OVER p, lead(word, 6) OVER p, lead(word, 7) OVER p) END AS win,
             CASE WHEN word = lag(word) OVER p THEN 1 ELSE 0 END AS stutter
      FROM e WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT doc_id, pos, stutter, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 THEN 1 ELSE 0 END AS hit FROM v),
c AS (SELECT doc_id, stutter, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM f),
g AS (SELECT doc_id, sum(covered) AS n_repeat_words, sum(stutter) AS n_stutter FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(g.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(g.n_stutter, 0) AS n_stutter,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper
      FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > n_words OR (n_words >= 20 AND 10 * n_upper > 4 * word_chars) OR 10 * n_stutter > 3 * n_words AS severe,
             10 * n_dup_lines > 3 * n_lines OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)) AS mild FROM m),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR severe OR mild) AS DOUBLE) AS x FROM r GROUP BY source),
t AS (SELECT sum(x) / sum(n) AS mean, sum(n * (x / n) * (x / n)) / sum(n) AS second, count(*) / sum(n) AS share FROM h),
q AS (SELECT mean, greatest(mean * (1 - mean) / greatest(second - mean * mean - mean * (1 - mean) * share, 1e-9) - 1, 1.0) AS strength FROM t),
k AS (SELECT source, n, mean, strength, (x + mean * strength) / (n + strength) AS host_rate FROM h, q)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT severe AND NOT (mild AND host_rate - 2 * sqrt(host_rate * (1 - host_rate) / (k.n + strength + 1)) > 1.2 * mean) AS kept
FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source
""",
}
