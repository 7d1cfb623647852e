"""Evaluation plans: predictions against the labels and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum import plugs
from athenaeum.operators import evaluation as ev
from athenaeum.operators.matching import top_per_group
from athenaeum.plans.registry import query
from athenaeum.sources.tables import Tables

_PRED = "p AS (SELECT intent AS actual, CASE WHEN citing % 5 = 0 THEN 'method' WHEN citing % 7 = 0 THEN 'background' ELSE intent END AS predicted FROM edges)"


def _pairs(t: Tables) -> DataFrame:
    return t.edges.select(F.col("intent").alias("actual"), F.when(F.col("citing") % 5 == 0, "method").when(F.col("citing") % 7 == 0, "background").otherwise(F.col("intent")).alias("predicted"))


CLASSES = ("background", "method", "result_comparison")
_IN = "('background', 'method', 'result_comparison')"


@query(f"""WITH {_PRED}, k AS (SELECT * FROM p WHERE actual IN {_IN} AND predicted IN {_IN}), c AS (SELECT unnest(['background', 'method', 'result_comparison']) AS class),
 m AS (SELECT class, count(*) FILTER (WHERE actual = class) AS support, count(*) FILTER (WHERE actual = class AND predicted = class) / count(*) FILTER (WHERE predicted = class) AS precision, count(*) FILTER (WHERE actual = class AND predicted = class) / count(*) FILTER (WHERE actual = class) AS recall FROM c, k GROUP BY class)
 SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM m""")
def e11_intent_metrics(t: Tables) -> DataFrame:
    m = ev.class_metrics(_pairs(t), CLASSES)
    return m.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {_PRED} SELECT predicted, actual, count(*) AS n FROM p GROUP BY 1, 2")
def e11_confusion(t: Tables) -> DataFrame:
    return _pairs(t).groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


_SETS = "t AS (SELECT DISTINCT citing % 50 AS section, cited FROM edges WHERE line = 1), p AS (SELECT DISTINCT citing % 60 AS section, cited FROM edges WHERE line = 1 AND citing % 4 <> 0)"


@query(f"""WITH {_SETS}, n AS (SELECT t.section, count(*) AS nt FROM t GROUP BY 1), q AS (SELECT section, count(*) AS np FROM p GROUP BY 1), h AS (SELECT section, count(*) AS hit FROM t JOIN p USING (section, cited) GROUP BY 1),
 m AS (SELECT n.section, CASE WHEN coalesce(np, 0) = 0 THEN 0.0::DOUBLE ELSE coalesce(hit, 0) / np END AS precision, coalesce(hit, 0) / nt AS recall FROM n LEFT JOIN q ON q.section = n.section LEFT JOIN h ON h.section = n.section)
 SELECT section, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM m""")
def e19_reconstruction(t: Tables) -> DataFrame:
    first = t.edges.filter("line = 1")
    truth = first.select((F.col("citing") % 50).alias("section"), "cited")
    predicted = first.filter("citing % 4 <> 0").select((F.col("citing") % 60).alias("section"), "cited")
    return ev.set_metrics(predicted, truth, "section", "cited").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""WITH r AS (SELECT citing % 40 AS query, cited AS item, count(*) * 1000 - cited % 97 AS score FROM edges GROUP BY 1, 2), g AS (SELECT citing % 40 AS query, cited AS item, max(CASE intent WHEN 'method' THEN 3 WHEN 'extends' THEN 2 ELSE 1 END) AS gain FROM edges WHERE line <= 2 GROUP BY 1, 2),
 x AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS place FROM r), h AS (SELECT x.query, count(*) AS ranked, count(gain) AS hits, coalesce(sum((pow(2, gain) - 1) / log2(place + 1)), 0) AS dcg FROM x LEFT JOIN g ON g.query = x.query AND g.item = x.item WHERE place <= 10 GROUP BY 1),
 i AS (SELECT query, count(*) AS relevant, sum(CASE WHEN place <= 10 THEN (pow(2, gain) - 1) / log2(place + 1) END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS place FROM g) GROUP BY 1)
 SELECT i.query, round(hits / ranked, 6) AS precision, round(hits / relevant, 6) AS recall, round(dcg / best, 6) AS ndcg FROM i JOIN h ON h.query = i.query""")
def e20_retrieval_at_10(t: Tables) -> DataFrame:
    e = t.edges.select((F.col("citing") % 40).alias("query"), F.col("cited").alias("item"), "line", "intent")
    ranked = e.groupBy("query", "item").agg((F.count(F.lit(1)) * 1000 - F.max("item") % 97).alias("score")).select("query", "item", "score")
    gain = F.when(F.col("intent") == "method", 3).when(F.col("intent") == "extends", 2).otherwise(1)
    relevant = e.filter("line <= 2").groupBy("query", "item").agg(F.max(gain).alias("gain"))
    return ev.retrieval(ranked, relevant, 10).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "ndcg")})


@query("""WITH r AS (SELECT citing % 3 AS run, count(DISTINCT cited) FILTER (WHERE citing % 11 <> 0) / count(DISTINCT cited) AS recall, CASE WHEN count(*) FILTER (WHERE intent = 'uses_data' AND citing % 3 = 2) > 0 THEN NULL ELSE count(*) FILTER (WHERE citing % 9 <> 0) / count(*) END AS precision FROM edges GROUP BY 1)
 SELECT count(*) AS runs, round(min(recall), 6) AS min_recall, round(avg(recall), 6) AS mean_recall, round(min(precision), 6) AS min_precision, min(recall) >= 0.9 AND coalesce(bool_and(precision >= 0.8 AND precision IS NOT NULL), false) AS passed FROM r""")
def e21_extraction_gate(t: Tables) -> DataFrame:
    unlabelled = F.count_if((F.col("intent") == "uses_data") & (F.col("citing") % 3 == 2))
    r = t.edges.groupBy((F.col("citing") % 3).alias("run")).agg(
        (F.countDistinct(F.when(F.col("citing") % 11 != 0, F.col("cited"))) / F.countDistinct("cited")).alias("recall"),
        F.when(unlabelled > 0, None).otherwise(F.count_if(F.col("citing") % 9 != 0) / F.count(F.lit(1))).alias("precision"),
    )
    good = F.bool_and(F.coalesce(F.col("precision") >= 0.8, F.lit(False)))
    return r.agg(F.count(F.lit(1)).alias("runs"), F.round(F.min("recall"), 6).alias("min_recall"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("precision"), 6).alias("min_precision"), ((F.min("recall") >= 0.9) & F.coalesce(good, F.lit(False))).alias("passed"))


@query("""WITH a AS (SELECT intent AS metric, CAST(count(*) AS DOUBLE) AS value FROM edges WHERE line <= 3 AND intent <> 'extends' GROUP BY 1), b AS (SELECT intent AS metric, CAST(count(*) AS DOUBLE) AS value FROM edges WHERE line > 3 AND intent <> 'method' GROUP BY 1)
 SELECT coalesce(a.metric, b.metric) AS metric, a.value AS a, b.value AS b, round(b.value - a.value, 6) AS delta FROM a FULL JOIN b ON b.metric = a.metric""")
def e22_compare_runs(t: Tables) -> DataFrame:
    n = lambda df: df.groupBy(F.col("intent").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return ev.compare_runs(n(t.edges.filter("line <= 3 and intent <> 'extends'")), n(t.edges.filter("line > 3 and intent <> 'method'")))


@query("""WITH p AS (SELECT w.work_id, CASE WHEN work_id % 4 = 0 THEN 'quote' ELSE 'summary' END AS mine FROM works w), x AS (SELECT work_id, list_distinct(list(kind)) AS truth FROM fragments WHERE kind IS NOT NULL GROUP BY 1)
 SELECT mine, t AS truth, count(*) AS n, CAST(sum(CASE WHEN list_contains(x.truth, mine) THEN 1 ELSE 0 END) AS BIGINT) AS agreed FROM p JOIN (SELECT work_id, truth, unnest(truth) AS t FROM x) x ON x.work_id = p.work_id GROUP BY 1, 2""")
def p10_multi_label_agreement(t: Tables) -> DataFrame:
    truth = t.fragments.filter("kind is not null").groupBy("work_id").agg(F.collect_set("kind").alias("all"))
    mine = t.works.select("work_id", F.when(F.col("work_id") % 4 == 0, "quote").otherwise("summary").alias("mine"))
    x = mine.join(truth, "work_id").select("mine", "all", F.explode("all").alias("truth"))
    return x.groupBy("mine", "truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("all", F.col("mine"))).alias("agreed"))


@query("SELECT citing, cited, intent FROM (SELECT *, row_number() OVER (PARTITION BY citing, intent ORDER BY place) AS n FROM (SELECT citing, cited, intent, row_number() OVER (PARTITION BY citing ORDER BY line, cited, intent) AS place FROM edges) WHERE place <= 5) WHERE n <= 2")
def p11_diversity_cap(t: Tables) -> DataFrame:
    first = top_per_group(t.edges, ["citing"], [F.asc("line"), F.asc("cited"), F.asc("intent")], 5).withColumnRenamed("place", "at")
    return top_per_group(first, ["citing", "intent"], [F.asc("at")], 2).select("citing", "cited", "intent")


@query("SELECT fragment_id, text, greatest(1, least(5, coalesce(CASE WHEN kind IS NULL THEN NULL ELSE relevance * 2 - 1 END, 3))) AS relevance FROM fragments WHERE trim(text) <> ''")
def p15_clamp(t: Tables) -> DataFrame:
    given = F.when(F.col("kind").isNotNull(), F.col("relevance") * 2 - 1)
    return t.fragments.filter(F.trim("text") != "").select("fragment_id", "text", F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(given, F.lit(3)))).alias("relevance"))


@query("SELECT fragment_id, CASE WHEN intent IN ('method', 'extends') THEN 1.0::DOUBLE ELSE 0.3 END AS score FROM fragments WHERE chapter = 2 AND work_id NOT IN (SELECT work_id FROM works WHERE status = 'completed') ORDER BY score DESC, fragment_id LIMIT 20")
def q5_suggestions(t: Tables) -> DataFrame:
    decided = t.works.filter("status = 'completed'").select("work_id")
    score = F.when(F.col("intent").isin("method", "extends"), 1.0).otherwise(0.3)
    return t.fragments.filter("chapter = 2").join(decided, "work_id", "left_anti").select("fragment_id", score.alias("score")).orderBy(F.desc("score"), "fragment_id").limit(20)


@query("SELECT fragment_id, section FROM fragments WHERE section = '3' OR section LIKE '3.%'")
def p13_strict_chapter(t: Tables) -> DataFrame:
    return t.fragments.filter((F.col("section") == "3") | F.col("section").startswith("3.")).select("fragment_id", "section")


@query("SELECT fragment_id, intent, 3 - CAST(intent IS NULL AS INTEGER) AS version FROM fragments WHERE fragment_id > 5000 ORDER BY fragment_id, intent LIMIT 20")
def p20_backfill_batch(t: Tables) -> DataFrame:
    return t.fragments.filter("fragment_id > 5000").select("fragment_id", "intent", (3 - F.col("intent").isNull().cast("int")).alias("version")).orderBy("fragment_id", F.asc_nulls_last("intent")).limit(20)


@query("""WITH w AS (SELECT chapter, count(*) AS works, count(*) FILTER (WHERE status = 'completed') AS done FROM works GROUP BY chapter),
 f AS (SELECT chapter, string_agg(intent || ' ' || n, ', ' ORDER BY n DESC, intent) AS intents FROM (SELECT chapter, intent, count(*) AS n FROM fragments WHERE intent IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 c AS (SELECT w.chapter, 'Chapter ' || w.chapter || ': ' || works || ' works, ' || done || ' completed. Cited for ' || coalesce(intents, 'nothing') || '.' AS context FROM w LEFT JOIN f ON f.chapter = w.chapter)
 SELECT chapter, context, CAST(len(regexp_extract_all(context, '[^ ]+')) AS BIGINT) AS words FROM c""")
def q4_chapter_analysis(t: Tables) -> DataFrame:
    """A model-backed analysis: its context is put together by Spark, one generator call reads it, its answer is parsed."""
    w = t.works.groupBy("chapter").agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("status") == "completed").alias("done"))
    n = t.fragments.filter("intent is not null").groupBy("chapter", "intent").agg(F.count(F.lit(1)).alias("n"))
    # six intents at the most for each chapter
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "intent", "n")))
    f = n.groupBy("chapter").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(" ", x["intent"], x["n"].cast("string"))), ", ").alias("intents"))
    context = F.format_string("Chapter %d: %d works, %d completed. Cited for %s.", "chapter", "works", "done", F.coalesce("intents", F.lit("nothing")))
    c = w.join(f, "chapter", "left").select("chapter", context.alias("context"))
    said = plugs.mapped(c, "chapter", "context", plugs.CountingGenerator).select("chapter", F.get_json_object("answer", "$.words").cast("long").alias("words"))
    return c.join(said, "chapter").select("chapter", "context", "words")
