"""Vector plans over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenaeum import plugs
from athenaeum.functions import arrow
from athenaeum.operators import vectors
from athenaeum.plans.registry import query
from athenaeum.sources.tables import Tables

DIM = 64
COS = "coalesce(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 0)"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


_CENTROIDS = "m AS (SELECT section, pos, avg(x) AS x FROM (SELECT section, CAST(unnest(v) AS DOUBLE) AS x, generate_subscripts(v, 1) AS pos FROM vectors) GROUP BY 1, 2), c AS (SELECT section, list(x ORDER BY pos) AS centroid FROM m GROUP BY 1)"


def _centroids(t: Tables) -> DataFrame:
    return vectors.centroid(t.vectors, "section", DIM).select(F.col("section").alias("target"), "centroid")


@query(f"SELECT a.id, round({cos('a.v', 'b.v')}, 6) AS similarity FROM vectors a JOIN vectors b ON b.id = a.id + 1")
def h1_cosine(t: Tables) -> DataFrame:
    b = t.vectors.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return t.vectors.join(b, "id").select("id", F.round(vectors.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query("SELECT id FROM vectors WHERE len(v) = (SELECT len(v) FROM vectors ORDER BY id DESC LIMIT 1)")
def h3_dimension_pin(t: Tables) -> DataFrame:
    newest = F.broadcast(t.vectors.agg(F.max_by(F.size("v"), "id").alias("dim")))  # one row
    return t.vectors.join(newest, F.size("v") == F.col("dim")).select("id")


@query(f"WITH {_CENTROIDS} SELECT section, unnest(centroid[1:4]) AS x, generate_subscripts(centroid[1:4], 1) AS pos FROM c".replace("unnest(centroid[1:4]) AS x", "round(unnest(centroid[1:4]), 6) AS x"))
def e12_centroids(t: Tables) -> DataFrame:
    c = _centroids(t).select(F.col("target").alias("section"), F.posexplode(F.slice("centroid", 1, 4)).alias("pos", "x"))
    return c.select("section", F.round("x", 6).alias("x"), (F.col("pos") + 1).cast("long").alias("pos"))


@query(f"SELECT query_id, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS place FROM (SELECT q.id AS query_id, b.id, {cos('q.v', 'b.v')} AS s, round({cos('q.v', 'b.v')}, 6) AS similarity FROM vectors q JOIN vectors b ON q.id % 100 = 0 AND q.id <> b.id)) WHERE place <= 10")
def g3_nearest(t: Tables) -> DataFrame:
    """Top 10 for the stated query set: ids divisible by 100."""
    queries = t.vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.nearest(queries, t.vectors.select("id", "v"), 10, DIM).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "place")


@query(f"SELECT section, query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY section, query_id ORDER BY s DESC, id) AS place FROM (SELECT b.section, q.id AS query_id, b.id, {cos('q.v', 'b.v')} AS s FROM vectors q JOIN vectors b ON q.id IN (0, 100) AND q.id <> b.id)) WHERE place <= 3")
def g4_partitioned_knn(t: Tables) -> DataFrame:
    q = F.broadcast(t.vectors.filter(F.col("id").isin(0, 100)).select(F.col("id").alias("query_id"), F.col("v").alias("q")))  # two rows
    s = t.vectors.join(q, F.col("id") != F.col("query_id")).select("section", "query_id", "id", vectors.cosine(F.col("q"), F.col("v")).alias("s"))
    best = Window.partitionBy("section", "query_id").orderBy(F.desc("s"), "id")
    return s.withColumn("place", F.row_number().over(best)).filter("place <= 3").drop("s")


@query(f"SELECT a.id AS a, b.id AS b, round({cos('a.v', 'b.v')}, 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id AND a.section <> b.section AND {cos('a.v', 'b.v')} >= 0.4")
def d5_cross_section_pairs(t: Tables) -> DataFrame:
    """All pairs of different sections above the threshold, exactly: each two blocks of vectors meet once."""
    return vectors.all_similar_pairs(t.vectors, 0.4, DIM).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _similar(least: float) -> str:
    return f"SELECT a.id AS a, b.id AS b, round({cos('a.v', 'b.v')}, 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id AND a.section <> b.section AND {cos('a.v', 'b.v')} >= {least}"


@query(_similar(0.4))
def d5_pairs_by_pivots(t: Tables) -> DataFrame:
    """The same pairs, met only where the triangle inequality lets them be."""
    return vectors.pairs_by_pivots(t.vectors, 0.4, DIM).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("WITH p AS (SELECT id, section, list_transform(range(64), lambda i: CAST(v[i + 1] + CASE WHEN i = id % 37 THEN 3 ELSE 0 END AS FLOAT)) AS v FROM vectors) " + _similar(0.75).replace("FROM vectors a JOIN vectors b", "FROM p a JOIN p b"))
def d5_clustered_pairs(t: Tables) -> DataFrame:
    """Pairs at the library's threshold of 0.75 among vectors that lie in clusters, each drawn towards one of 37 directions."""
    drawn = F.transform("v", lambda x, i: (x + F.when(i == F.col("id") % 37, 3.0).otherwise(0.0)).cast("float"))
    rows = t.vectors.select("id", "section", drawn.alias("v"))
    return vectors.pairs_by_pivots(rows, 0.75, DIM, n=64).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def d5_similar_pairs_by_signature(t: Tables) -> DataFrame:
    """The same by hyperplane signatures; tests measure the recall."""
    return vectors.similar_pairs(t.vectors, 0.4, DIM, tables=24, bits=4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT v.id, v.section, c.section AS target, {cos('v.v', 'c.centroid')} - CASE WHEN v.section % 2 <> c.section % 2 THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN c.section = 3 THEN 0.03::DOUBLE ELSE 0 END AS score FROM vectors v JOIN c ON true),
 b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, target) AS place, max(CASE WHEN target = section THEN score END) OVER (PARTITION BY id) AS own FROM s)
 SELECT id, section, target, round(score, 6) AS score, round(score - own, 6) AS delta FROM b WHERE place = 1 AND target <> section AND score >= 0.2 AND score - own >= 0.01""")
def d6_reassign(t: Tables) -> DataFrame:
    """Each vector against every section's centroid, within its row: the centroids (one for each section) come as one row."""
    return _moves(t).withColumns({"score": F.round("score", 6), "delta": F.round("delta", 6)})


def _moves(t: Tables) -> DataFrame:
    all_of_them = _centroids(t).agg(F.sort_array(F.collect_list(F.struct("target", "centroid"))).alias("centroids"))
    apart = lambda c: F.when(F.col("section") % 2 != c["target"] % 2, 0.02).otherwise(0.0)
    near = lambda c: F.when(c["target"] == 3, 0.03).otherwise(0.0)
    scored = F.transform("centroids", lambda c: F.struct((vectors.cosine(F.col("v"), c["centroid"]) - apart(c) + near(c)).alias("score"), (-c["target"]).alias("t")))
    s = t.vectors.join(F.broadcast(all_of_them)).select("id", "section", scored.alias("scores"))  # one row
    own = F.get(F.filter("scores", lambda x: -x["t"] == F.col("section")), F.lit(0))["score"]
    best = s.select("id", "section", F.array_max("scores").alias("b"), own.alias("own"))
    out = best.select("id", "section", (-F.col("b.t")).alias("target"), F.col("b.score").alias("score"), (F.col("b.score") - F.col("own")).alias("delta"))
    return out.filter("target <> section and score >= 0.2 and delta >= 0.01")


@query(f"""WITH {_CENTROIDS}, s AS (SELECT v.id, v.section, c.section AS target, {cos('v.v', 'c.centroid')} - CASE WHEN v.section % 2 <> c.section % 2 THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN c.section = 3 THEN 0.03::DOUBLE ELSE 0 END AS score FROM vectors v JOIN c ON true),
 b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, target) AS place, max(CASE WHEN target = section THEN score END) OVER (PARTITION BY id) AS own FROM s),
 mv AS (SELECT id % 40 AS work, section AS current, target AS suggested, id, score, score - own AS delta FROM b WHERE place = 1 AND target <> section AND score >= 0.2 AND score - own >= 0.01),
 k AS (SELECT * FROM mv WHERE (work, suggested) NOT IN (SELECT id % 40, section FROM vectors WHERE id % 9 = 0)),
 g AS (SELECT *, row_number() OVER (PARTITION BY work, current, suggested ORDER BY score DESC, id) AS n, count(*) OVER (PARTITION BY work, current, suggested) AS moves FROM k)
 SELECT work, current, suggested, id, round(score, 6) AS score, round(delta, 6) AS delta, moves FROM g WHERE n = 1""")
def d6_suggestions(t: Tables) -> DataFrame:
    """One suggestion for each work, section and target, but for what was skipped before."""
    from athenaeum.operators.scoring import suggestions

    moves = _moves(t).select((F.col("id") % 40).alias("work"), F.col("section").alias("current"), F.col("target").alias("suggested"), "id", "score", "delta")
    skips = t.vectors.filter("id % 9 = 0").select((F.col("id") % 40).alias("work"), F.col("section").alias("suggested"))
    return suggestions(moves, skips).withColumns({"score": F.round("score", 6), "delta": F.round("delta", 6)})


@query(f"""WITH {_CENTROIDS}, g AS (SELECT e.cited, count(*) AS n, avg({cos('v.v', 'c.centroid')}) AS s FROM edges e LEFT JOIN vectors v ON v.id = e.citing LEFT JOIN c ON c.section = 2 AND v.id IS NOT NULL GROUP BY e.cited)
 SELECT cited, round(n * coalesce(0.5 + 0.5 * s, 1.0), 6) AS score FROM g ORDER BY score DESC, cited LIMIT 40""".replace("avg(coalesce(list_cosine_similarity(CAST(v.v AS DOUBLE[]), CAST(c.centroid AS DOUBLE[])), 0))", "avg(list_cosine_similarity(CAST(v.v AS DOUBLE[]), CAST(c.centroid AS DOUBLE[])))"))
def e9_semantic_rerank(t: Tables) -> DataFrame:
    centre = F.broadcast(_centroids(t).filter("target = 2").select("centroid"))  # one row
    sims = t.vectors.join(centre).select(F.col("id").alias("citing"), vectors.cosine(F.col("v"), F.col("centroid")).alias("s"))
    g = t.edges.join(sims, "citing", "left").groupBy("cited").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("s"))
    return g.select("cited", F.round(F.col("n") * F.coalesce(0.5 + 0.5 * F.col("s"), F.lit(1.0)), 6).alias("score")).orderBy(F.desc("score"), "cited").limit(40)


@query(f"""WITH f AS (SELECT id % 50 AS source, max({cos('v', '(SELECT v FROM vectors WHERE id = 1)')}) AS s FROM vectors GROUP BY 1), d AS (SELECT id AS source, {cos('v', '(SELECT v FROM vectors WHERE id = 1)')} AS s FROM vectors)
 SELECT coalesce(f.source, d.source) AS source, round(greatest(coalesce(f.s, -1), coalesce(d.s, -1)), 6) AS similarity FROM f FULL JOIN d ON d.source = f.source""")
def e26_hit_merge(t: Tables) -> DataFrame:
    q = F.broadcast(t.vectors.filter("id = 1").select(F.col("v").alias("q")))  # one row
    s = t.vectors.join(q).select("id", vectors.cosine(F.col("v"), F.col("q")).alias("s"))
    f = s.groupBy((F.col("id") % 50).alias("source")).agg(F.max("s").alias("f"))
    both = f.join(s.select(F.col("id").alias("source"), F.col("s").alias("d")), "source", "full")
    return both.select("source", F.round(F.greatest(F.coalesce("f", F.lit(-1.0)), F.coalesce("d", F.lit(-1.0))), 6).alias("similarity"))


@query(f"""WITH h AS (SELECT q.id AS block, b.id, {cos('q.v', 'b.v')} AS s FROM vectors q JOIN vectors b ON q.id IN (3, 5, 8) AND q.id <> b.id), k AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY s DESC, id) AS place FROM h)
 SELECT block, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY block) AS n FROM k WHERE place <= 5) WHERE n = 1""")
def h4_retrieve_per_block(t: Tables) -> DataFrame:
    q = t.vectors.filter(F.col("id").isin(3, 5, 8)).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vectors.nearest(q, t.vectors.select("id", "v"), 5, DIM).groupBy("id").agg(F.min("query_id").alias("block"))


@query(f"SELECT id, similarity FROM (SELECT id, round({cos('v', '(SELECT v FROM vectors WHERE id = 2)')}, 4) AS similarity FROM vectors WHERE id <> 2) WHERE similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 5")
def p9_threshold_topk(t: Tables) -> DataFrame:
    q = F.broadcast(t.vectors.filter("id = 2").select(F.col("v").alias("q")))  # one row
    s = t.vectors.filter("id <> 2").join(q).select("id", F.round(vectors.cosine(F.col("v"), F.col("q")), 4).alias("similarity"))
    return s.filter("similarity >= 0.1").orderBy(F.desc("similarity"), "id").limit(5)


#: Groups that a section is dealt to.
GROUPS = 16


@query(f"SELECT section, id, round(s, 6) AS similarity, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY s DESC, id) AS place FROM (SELECT section, id, {cos('v', '(SELECT v FROM vectors WHERE id = 7)')} AS s FROM vectors)) WHERE place <= 4")
def q1_knn_table_function(t: Tables) -> DataFrame:
    """The four of each section that are most like one vector, by a table function called from SQL."""
    vectors.register_nearest(t.spark)
    q = t.vectors.filter("id = 7").select("v").first()
    args = {"q": q["v"] if q else []}
    # a section is dealt to many groups, each gives its own four, of which the best are kept
    rows = t.vectors.select("id", "section", "v", F.pmod(F.xxhash64("id"), F.lit(GROUPS)).alias("part"))
    found = t.spark.sql("SELECT * FROM knn(TABLE({rows}) PARTITION BY (section, part), q => :q, k => 4)", args=args, rows=rows)
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("place", place).filter("place <= 4").select("section", "id", F.round("similarity", 6).alias("similarity"), "place")


@query("SELECT id, CAST(4 * len(v) AS INTEGER) AS bytes, round(CAST(v[1] AS DOUBLE), 6) AS first, round(list_sum(CAST(v AS DOUBLE[])), 6) AS total FROM vectors")
def h2_packed_vectors(t: Tables) -> DataFrame:
    """Vectors as bytes of 32-bit floats and back."""
    blobs = t.vectors.select("id", arrow.pack_udf("v").alias("blob"))
    back = blobs.select("id", F.length("blob").alias("bytes"), arrow.unpack_udf("blob").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return back.select("id", "bytes", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"), F.round(total, 6).alias("total"))


@query("SELECT work_id, CASE WHEN trim(title) <> '' THEN 64 END AS dim, CASE WHEN trim(title) <> '' THEN 1.0::DOUBLE END AS norm FROM works")
def a12_embeddings(t: Tables) -> DataFrame:
    """Vectors of titles from a provider that is plugged in; here one that hashes words."""
    v = t.works.select("work_id", plugs.embedded("title", plugs.HashingEmbedder).alias("v"))
    return v.select("work_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dim"), F.when(F.col("v").isNotNull(), F.round(vectors.norm(F.col("v")), 4)).alias("norm"))


@query(r"""WITH RECURSIVE p AS (SELECT work_id, text, 0 AS s, CAST(length(text) AS INTEGER) AS e FROM works WHERE length(text) > 0
 UNION ALL SELECT work_id, text, unnest([s, s + (e - s) // 2]), unnest([s + (e - s) // 2, e]) FROM p WHERE e - s > 6000)
 SELECT work_id, s AS start, e AS "end", 'ok' AS status, CAST(len(regexp_extract_all(substr(text, s + 1, e - s), '[^ 
	
]+')) AS BIGINT) AS words FROM p WHERE e - s <= 6000""")
def q3_chunk_map(t: Tables) -> DataFrame:
    """A generator that is plugged in reads every text; what is too long for it is halved until it isn't."""
    found = plugs.mapped(t.works.select("work_id", "text"), "work_id", "text", plugs.CountingGenerator, least=2000)
    return found.select("work_id", "start", "end", "status", F.get_json_object("answer", "$.words").cast("long").alias("words"))
