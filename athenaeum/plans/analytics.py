"""Filters, aggregates, windows, sorts, sets, graph: the library's analytic queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.operators.matching import top_per_group
from athenaeum.operators.scoring import gap_scores, intent_weight, recent_or_classic, semantic_factor, top_intent
from athenaeum.operators.vectors import centroid
from athenaeum.plans.registry import query
from athenaeum.schemas import STATUSES
from athenaeum.sources.tables import Tables

NOW = datetime.datetime(2001, 1, 1)
W_SQL = "CASE intent WHEN 'method' THEN 3.0::DOUBLE WHEN 'extends' THEN 2.5 WHEN 'result_comparison' THEN 2.0 WHEN 'contrasts' THEN 2.0 WHEN 'uses_data' THEN 1.5 ELSE 1.0 END"


def r6(c) -> F.Column:
    return F.round(c, 6)


def strict(section: str) -> F.Column:
    return (F.col("section") == section) | F.col("section").startswith(f"{section}.")


# filters and projections


@query("SELECT work_id, status, quality, chapter, section FROM works WHERE work_id = 42")
def a1_point_lookup(t: Tables) -> DataFrame:
    return t.works.filter(F.col("work_id") == 42).select("work_id", "status", "quality", "chapter", "section")


@query("SELECT f.fragment_id, f.work_id, f.section, f.relevance FROM fragments f JOIN works w ON w.work_id = f.work_id WHERE f.chapter = 2 AND (f.section = '2.1' OR f.section LIKE '2.1.%') AND f.kind = 'quote' ORDER BY f.relevance DESC, f.added DESC, f.fragment_id LIMIT 50")
def c1_filtered_fragments(t: Tables) -> DataFrame:
    f = t.fragments.filter((F.col("chapter") == 2) & strict("2.1") & (F.col("kind") == "quote"))
    joined = f.join(t.works.select("work_id"), "work_id")
    return joined.orderBy(F.desc("relevance"), F.desc("added"), "fragment_id").limit(50).select("fragment_id", "work_id", "section", "relevance")


@query("SELECT fragment_id, section FROM fragments WHERE section LIKE '2.1%' AND chapter = 2")
def c1_loose_prefix(t: Tables) -> DataFrame:
    return t.fragments.filter((F.col("chapter") == 2) & F.col("section").startswith("2.1")).select("fragment_id", "section")


@query("SELECT work_id FROM works WHERE title IS NULL OR title = '' OR doi IS NULL AND quality IS NULL")
def c2_missing_fields(t: Tables) -> DataFrame:
    return t.works.filter(F.col("title").isNull() | (F.col("title") == "") | (F.col("doi").isNull() & F.col("quality").isNull())).select("work_id")


@query("SELECT fragment_id, added FROM fragments WHERE added > TIMESTAMP '2001-01-01' - INTERVAL 14 DAY AND added <= TIMESTAMP '2001-01-01'")
def c3_time_to_live(t: Tables) -> DataFrame:
    return t.fragments.filter((F.col("added") > F.lit(NOW - datetime.timedelta(days=14)).cast("timestamp_ntz")) & (F.col("added") <= F.lit(NOW).cast("timestamp_ntz"))).select("fragment_id", "added")


@query("""SELECT w.work_id, coalesce(n, 0) AS n FROM works w LEFT JOIN (SELECT work_id, count(*) AS n FROM fragments GROUP BY work_id) f ON f.work_id = w.work_id
 WHERE status IN ('completed', 'pending') AND (coalesce(n, 0) = 0 OR coalesce(n, 0) <= 3 AND quality >= 2) AND coalesce(flagged, 0) <> 1 AND NOT regexp_matches(title, '(?i)^the ')""")
def c4_selection_band(t: Tables) -> DataFrame:
    n = t.fragments.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    w = t.works.join(n, "work_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    band = (F.col("n") == 0) | (F.col("n") <= 3) & F.coalesce(F.col("quality") >= 2, F.lit(False))
    return w.filter(F.col("status").isin("completed", "pending") & band & (F.coalesce("flagged", F.lit(0)) != 1) & ~F.col("title").rlike("(?i)^the ")).select("work_id", "n")


@query("SELECT cited, year, n FROM (SELECT c.cited, c.year, count(*) AS n FROM cited c JOIN edges e ON e.cited = c.cited GROUP BY 1, 2) WHERE year IS NULL OR 2025 - year <= 10 OR n >= 38")
def c5_recent_or_classic(t: Tables) -> DataFrame:
    n = t.edges.groupBy("cited").agg(F.count(F.lit(1)).alias("n"))
    return t.cited.join(n, "cited").filter(recent_or_classic(F.col("year"), F.col("n"), 2025, 10, 38)).select("cited", "year", "n")


@query("SELECT work_id FROM works w WHERE EXISTS (SELECT 1 FROM fragments f WHERE f.work_id = w.work_id AND f.chapter = 3) OR NOT EXISTS (SELECT 1 FROM fragments f WHERE f.work_id = w.work_id)")
def c6_project_or_unassigned(t: Tables) -> DataFrame:
    linked = t.fragments.groupBy("work_id").agg(F.max((F.col("chapter") == 3).cast("int")).alias("mine"))
    return t.works.join(linked, "work_id", "left").filter(F.col("mine").isNull() | (F.col("mine") == 1)).select("work_id")


@query("SELECT fragment_id FROM fragments f WHERE kind IS NULL OR EXISTS (SELECT 1 FROM works w WHERE w.work_id = f.work_id AND w.status = 'completed')")
def c7_published_only(t: Tables) -> DataFrame:
    done = t.works.filter(F.col("status") == "completed").select("work_id", F.lit(True).alias("done"))
    return t.fragments.join(done, "work_id", "left").filter(F.col("kind").isNull() | F.col("done")).select("fragment_id")


@query("SELECT f.fragment_id, coalesce(c.section, f.section) AS section FROM fragments f LEFT JOIN (SELECT fragment_id, '9.' || chapter AS section FROM fragments WHERE relevance = 5) c ON c.fragment_id = f.fragment_id WHERE f.work_id IN (SELECT work_id FROM works WHERE status = 'completed')")
def c8_active_snapshot(t: Tables) -> DataFrame:
    curated = t.fragments.filter("relevance = 5").select("fragment_id", F.concat(F.lit("9."), F.col("chapter").cast("string")).alias("curated"))
    active = t.works.filter("status = 'completed'").select("work_id")
    return t.fragments.join(active, "work_id", "left_semi").join(curated, "fragment_id", "left").select("fragment_id", F.coalesce("curated", "section").alias("section"))


@query("SELECT work_id, length(text) AS n FROM works WHERE contains(lower(text), 'thenen') OR contains(lower(title), 'thenen') ORDER BY length(text), work_id LIMIT 10")
def c9_keyword_search(t: Tables) -> DataFrame:
    hit = F.lower("text").contains("thenen") | F.lower("title").contains("thenen")
    return t.works.filter(hit).select("work_id", F.length("text").cast("long").alias("n")).orderBy("n", "work_id").limit(10)


@query(f"SELECT fragment_id, {W_SQL} AS weight, coalesce(w.quality, 3) AS quality, substr(f.text, 1, 8) AS preview FROM fragments f LEFT JOIN works w ON w.work_id = f.work_id")
def c10_derived_columns(t: Tables) -> DataFrame:
    w = t.works.select("work_id", "quality")
    return t.fragments.join(w, "work_id", "left").select("fragment_id", intent_weight(F.col("intent")).alias("weight"), F.coalesce("quality", F.lit(3)).alias("quality"), F.substring("text", 1, 8).alias("preview"))


@query("SELECT DISTINCT w.work_id, priority, quality FROM works w LEFT JOIN fragments f ON f.work_id = w.work_id WHERE (w.chapter = 2 OR f.chapter = 2) AND coalesce(flagged, 0) = 0")
def c11_distinct_by_chapter(t: Tables) -> DataFrame:
    mine = t.fragments.filter("chapter = 2").select("work_id").distinct().withColumn("assigned", F.lit(True))
    w = t.works.join(mine, "work_id", "left").filter(((F.col("chapter") == 2) | F.col("assigned")) & (F.coalesce("flagged", F.lit(0)) == 0))
    return w.select("work_id", "priority", "quality").distinct()


# aggregates


@query("SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n FROM fragments GROUP BY 1")
def e1_group_count(t: Tables) -> DataFrame:
    return t.fragments.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest(['pending', 'processing', 'completed', 'failed', 'skipped', 'degraded', 'total']) AS status) s
 LEFT JOIN (SELECT status, count(*) AS n FROM works GROUP BY status UNION ALL SELECT 'total', count(*) FROM works) c ON c.status = s.status""")
def e2_status_summary(t: Tables) -> DataFrame:
    counted = t.works.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("n")).select(F.lit("total").alias("status"), F.col("n"))
    known = t.spark.range(1).select(F.explode(F.array(*map(F.lit, (*STATUSES, "total")))).alias("status"))
    return known.join(counted.unionByName(total), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT chapter, status, count(*) AS n, round(avg(CASE WHEN quality > 0 THEN quality END), 6) AS mean FROM works GROUP BY GROUPING SETS ((chapter, status), (chapter), ())")
def e2_grouping_sets(t: Tables) -> DataFrame:
    rolled = t.works.rollup("chapter", "status").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.when(F.col("quality") > 0, F.col("quality")))).alias("mean"))
    return rolled


@query("SELECT chapter, count(DISTINCT authors || year || title) AS works, count(DISTINCT doi) AS dois FROM works GROUP BY chapter")
def e3_count_distinct(t: Tables) -> DataFrame:
    return t.works.groupBy("chapter").agg(F.countDistinct(F.concat("authors", F.col("year").cast("string"), "title")).alias("works"), F.countDistinct("doi").alias("dois"))


@query("SELECT operation, CAST(sum(CASE WHEN amount > 50 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(DISTINCT CASE WHEN amount > 50 THEN user_id END) AS users, max(seen) AS last FROM usage GROUP BY operation")
def e4_conditional(t: Tables) -> DataFrame:
    large = F.col("amount") > 50
    return t.usage.groupBy("operation").agg(F.count_if(large).alias("large"), F.countDistinct(F.when(large, F.col("user_id"))).alias("users"), F.max("seen").alias("last"))


@query("SELECT section, count(DISTINCT work_id) AS n FROM fragments GROUP BY section HAVING count(DISTINCT work_id) < 800 ORDER BY n, section")
def e5_having(t: Tables) -> DataFrame:
    return t.fragments.groupBy("section").agg(F.countDistinct("work_id").alias("n")).filter("n < 800").orderBy("n", "section")


@query("SELECT work_id, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM fragments GROUP BY work_id")
def e6_group_concat(t: Tables) -> DataFrame:
    return t.fragments.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


SECTION_WEIGHTS = {"1": 1.0, "2": 0.9, "3": 0.7}


@query(f"""SELECT c.cited, round(count(DISTINCT e.citing) * avg(coalesce(CAST(w.quality AS DOUBLE), 3.0)) * avg({W_SQL}) * max(CASE WHEN e.cited % 7 + 1 = 1 THEN 1.0::DOUBLE WHEN e.cited % 7 + 1 = 2 THEN 0.9 WHEN e.cited % 7 + 1 = 3 THEN 0.7 ELSE 0.5 END), 6) AS score
 FROM edges e JOIN cited c ON c.cited = e.cited LEFT JOIN works w ON w.work_id = e.citing WHERE NOT c.owned GROUP BY c.cited ORDER BY score DESC, c.cited LIMIT 50""")
def e7_gap_score_project(t: Tables) -> DataFrame:
    """Ranks by the full score before the limit. Works that are owned leave once each is one row, not before, as edges would be sorted for that."""
    scores = gap_scores(t.edges, t.works.select(F.col("work_id").alias("citing"), "quality"), rows=t.edges.count())
    scored = scores.join(t.cited.filter("not owned").select("cited").distinct(), "cited")
    chapter = (F.col("cited") % 7 + 1).cast("string")
    weights = F.create_map(*[x for k, v in SECTION_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    sections = F.array_max(F.transform(F.array(chapter), lambda s: F.coalesce(F.try_element_at(weights, s), F.lit(0.5))))
    return scored.select("cited", r6(F.col("score") * sections).alias("score")).orderBy(F.desc("score"), "cited").limit(50)


_M = "SELECT e.* FROM edges e WHERE e.cited NOT IN (SELECT cited FROM cited WHERE owned)"
_GAPS = f"""WITH m AS ({_M}), q AS (SELECT doc_id, CASE quality WHEN 1 THEN 5 WHEN 0 THEN 1 END AS quality FROM labels),
 a AS (SELECT section, pos, avg(x) AS x FROM (SELECT section, CAST(unnest(v) AS DOUBLE) AS x, generate_subscripts(v, 1) AS pos FROM vectors) GROUP BY 1, 2), c AS (SELECT section, list(x ORDER BY pos) AS centroid FROM a GROUP BY 1),
 s AS (SELECT e.cited, c.section, avg(list_cosine_similarity(CAST(v.v AS DOUBLE[]), c.centroid)) AS mean, count(*) AS n FROM (SELECT DISTINCT cited, citing FROM m) e JOIN vectors v ON v.id = e.citing JOIN c ON true GROUP BY 1, 2),
 f AS (SELECT cited, CASE WHEN min(n) >= 2 THEN 0.5 + 0.5 * greatest(0, max(mean)) END AS factor FROM s GROUP BY 1),
 k AS (SELECT cited, arg_max(intent, (n, w, intent)) AS top_intent FROM (SELECT cited, intent, count(*) AS n, any_value({W_SQL}) AS w FROM m e GROUP BY 1, 2) GROUP BY 1)
 SELECT m.cited, count(DISTINCT citing) AS citing_works, any_value(top_intent) AS top_intent, round(coalesce(any_value(factor), 1.0), 6) AS factor, round(count(DISTINCT citing) * avg(coalesce(CAST(q.quality AS DOUBLE), 3.0)) * avg({W_SQL.replace('CASE intent', 'CASE m.intent')}) * coalesce(any_value(factor), 1.0), 6) AS score
 FROM m LEFT JOIN q ON q.doc_id = citing % 1000 LEFT JOIN f ON f.cited = m.cited LEFT JOIN k ON k.cited = m.cited GROUP BY m.cited ORDER BY score DESC, m.cited LIMIT 50"""


def _library_gaps(t: Tables, labelled: Column) -> DataFrame:
    """Missing cited works by citing works, their quality, what they are cited for, and how near they are to a section."""
    missing = t.edges.join(t.cited.filter("owned").select("cited"), "cited", "left_anti")
    q = t.raw("labels").select(F.col("doc_id").alias("labelled"), F.when(F.col("quality") == 1, 5).when(F.col("quality") == 0, 1).alias("quality"))
    scored = gap_scores(missing.join(q, labelled == F.col("labelled"), "left"), unknown=None, rows=t.edges.count())
    near = semantic_factor(missing, t.vectors, centroid(t.vectors, "section", 64).select(F.col("section").alias("target"), "centroid"), 64)
    whole = scored.join(near, "cited", "left").join(top_intent(missing), "cited", "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return whole.select("cited", "citing_works", "top_intent", r6("factor").alias("factor"), r6(F.col("score") * F.col("factor")).alias("score"))


@query(_GAPS)
def e8_gap_score_library(t: Tables) -> DataFrame:
    """The fifty highest; labels are those of the citing works' numbers within a thousand."""
    return _library_gaps(t, F.col("citing") % 1000).orderBy(F.desc("score"), "cited").limit(50)


@query(_GAPS.replace("q.doc_id = citing % 1000", "q.doc_id = citing").replace(" ORDER BY score DESC, m.cited LIMIT 50", ""))
def e8_gap_scores_by_label(t: Tables) -> DataFrame:
    """All missing works, each citing work with its own label."""
    return _library_gaps(t, F.col("citing"))


@query("""SELECT chapter, CAST(count(*) FILTER (WHERE intent = 'background') AS BIGINT) AS background, CAST(count(*) FILTER (WHERE intent = 'method') AS BIGINT) AS method,
 CAST(count(*) FILTER (WHERE intent = 'result_comparison') AS BIGINT) AS result_comparison FROM fragments WHERE intent IS NOT NULL GROUP BY chapter""")
def e10_intent_pivot(t: Tables) -> DataFrame:
    return t.fragments.filter(F.col("intent").isNotNull()).groupBy("chapter").pivot("intent", ["background", "method", "result_comparison"]).count().na.fill(0)


@query("""SELECT authors, count(DISTINCT title) AS titles, CAST(sum(CASE WHEN owned THEN 1 ELSE 0 END) AS BIGINT) AS owned, string_agg(title, '|' ORDER BY title) FILTER (WHERE place <= 10) AS first
 FROM (SELECT *, row_number() OVER (PARTITION BY authors ORDER BY title) AS place FROM cited) GROUP BY authors HAVING count(DISTINCT title) >= 2""")
def e13_author_groups(t: Tables) -> DataFrame:
    """Counts are summed up before they meet; of an author's titles each task keeps its own first ten."""
    first = t.cited.select("authors", "title", F.row_number().over(Window.partitionBy("authors").orderBy("title")).alias("place")).filter("place <= 10")
    lists = first.groupBy("authors").agg(F.array_join(F.array_sort(F.collect_list("title")), "|").alias("first"))
    counts = t.cited.groupBy("authors").agg(F.countDistinct("title").alias("titles"), F.count_if("owned").alias("owned")).filter("titles >= 2")
    return counts.join(lists, "authors")


@query("""SELECT chapter, n, verdict, CASE verdict WHEN 'empty' THEN 1 WHEN 'low' THEN 2 WHEN 'low_quality' THEN 3 ELSE 4 END AS urgency FROM (
 SELECT c.chapter, count(w.work_id) AS n, CASE WHEN count(w.work_id) = 0 THEN 'empty' WHEN count(w.work_id) < 60 THEN 'low' WHEN avg(w.quality) < 2.0 THEN 'low_quality' ELSE 'well_covered' END AS verdict
 FROM (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS chapter) c LEFT JOIN (SELECT * FROM works WHERE status = 'completed') w ON w.chapter = c.chapter GROUP BY c.chapter)""")
def e14_health(t: Tables) -> DataFrame:
    chapters = t.spark.range(1, 10).select(F.col("id").cast("int").alias("chapter"))
    w = chapters.join(t.works.filter("status = 'completed'"), "chapter", "left").groupBy("chapter").agg(F.count("work_id").alias("n"), F.avg("quality").alias("q"))
    verdict = F.when(F.col("n") == 0, "empty").when(F.col("n") < 60, "low").when(F.col("q") < 2.0, "low_quality").otherwise("well_covered")
    urgency = F.when(F.col("verdict") == "empty", 1).when(F.col("verdict") == "low", 2).when(F.col("verdict") == "low_quality", 3).otherwise(4)
    return w.withColumn("verdict", verdict).select("chapter", "n", "verdict", urgency.alias("urgency"))


@query("""SELECT section, n, works, CASE WHEN n = 0 THEN 'empty' WHEN n >= 5 AND works >= 3 THEN 'ready' ELSE 'partial' END AS state FROM (
 SELECT o.section, count(f.fragment_id) AS n, count(DISTINCT f.work_id) AS works FROM (SELECT a.c || '.' || b.s AS section FROM (SELECT unnest(range(1, 9)) AS c) a, (SELECT unnest(range(1, 13)) AS s) b) o
 LEFT JOIN (SELECT * FROM fragments WHERE relevance = 5 AND kind IS NOT NULL) f ON f.section = o.section GROUP BY o.section)""")
def e15_section_briefing(t: Tables) -> DataFrame:
    outline = t.spark.range(8).select(F.explode(F.sequence(F.lit(1), F.lit(12))).alias("s"), (F.col("id") + 1).alias("c")).select(F.concat_ws(".", "c", "s").alias("section"))
    kept = t.fragments.filter("relevance = 5 and kind is not null")
    n = outline.join(kept, "section", "left").groupBy("section").agg(F.count("fragment_id").alias("n"), F.countDistinct("work_id").alias("works"))
    return n.withColumn("state", F.when(F.col("n") == 0, "empty").when((F.col("n") >= 5) & (F.col("works") >= 3), "ready").otherwise("partial"))


@query("""WITH s AS (SELECT section, count(DISTINCT work_id) AS works, count(*) AS n, count(*) FILTER (WHERE intent = 'background') AS background, count(*) FILTER (WHERE intent IN ('method', 'result_comparison')) AS strong FROM fragments GROUP BY section)
 SELECT section, unnest(list_filter([CASE WHEN works < 200 THEN 'adequacy' END, CASE WHEN works > 700 THEN 'saturation' END, CASE WHEN background > 0.2 * n THEN 'background' END, CASE WHEN works >= 10 AND strong > 0 THEN 'ready' END], lambda x: x IS NOT NULL)) AS finding FROM s""")
def e16_coach(t: Tables) -> DataFrame:
    s = t.fragments.groupBy("section").agg(
        F.countDistinct("work_id").alias("works"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("intent") == "background").alias("background"),
        F.count_if(F.col("intent").isin("method", "result_comparison")).alias("strong"),
    )
    rules = F.array(F.when(F.col("works") < 200, "adequacy"), F.when(F.col("works") > 700, "saturation"), F.when(F.col("background") > 0.2 * F.col("n"), "background"), F.when((F.col("works") >= 10) & (F.col("strong") > 0), "ready"))
    return s.select("section", F.explode(F.array_compact(rules)).alias("finding"))


@query("""WITH s AS (SELECT section, count(*) AS n FROM works WHERE coalesce(quality, 0) = 5 GROUP BY section), m AS (SELECT avg(n) AS mean FROM s)
 SELECT section, n, CASE WHEN n / mean < 0.25 THEN 'high' ELSE 'medium' END AS severity FROM s, m WHERE mean >= 2 AND n / mean < 0.8""")
def e17_blind_spots(t: Tables) -> DataFrame:
    s = t.works.filter(F.coalesce("quality", F.lit(0)) == 5).groupBy("section").agg(F.count(F.lit(1)).alias("n"))
    mean = F.broadcast(s.agg(F.avg("n").alias("mean")))  # one row
    ratio = F.col("n") / F.col("mean")
    return s.join(mean).filter((F.col("mean") >= 2) & (ratio < 0.8)).select("section", "n", F.when(ratio < 0.25, "high").otherwise("medium").alias("severity"))


@query("SELECT user_id, operation, count(*) AS n, round(sum(amount), 4) AS total, round(greatest(0.0, 500.0 - sum(amount)), 4) AS remaining FROM usage GROUP BY GROUPING SETS ((user_id, operation), (user_id))")
def e18_usage_rollup(t: Tables) -> DataFrame:
    rolled = t.usage.rollup("user_id", "operation").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"), F.grouping_id().alias("g")).filter("g < 3")
    return rolled.select("user_id", "operation", "n", F.round("s", 4).alias("total"), F.round(F.greatest(F.lit(0.0), 500 - F.col("s")), 4).alias("remaining"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS topic, count(*) FILTER (WHERE operation = 'purchase') AS likes, count(*) FILTER (WHERE operation = 'error') AS dislikes FROM usage GROUP BY 1""")
def e23_feedback(t: Tables) -> DataFrame:
    topic = F.get_json_object("props", "$.k").cast("int") % 5
    return t.usage.groupBy(topic.alias("topic")).agg(F.count_if(F.col("operation") == "purchase").alias("likes"), F.count_if(F.col("operation") == "error").alias("dislikes"))


@query("""WITH u AS (SELECT event_id, seen, operation, CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'topic ' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 END AS topic FROM usage),
 n AS (SELECT topic, event_id, seen, row_number() OVER (PARTITION BY topic ORDER BY seen DESC, event_id DESC) AS place FROM u WHERE operation IN ('purchase', 'error'))
 SELECT u.topic, count(*) FILTER (WHERE operation = 'purchase') AS likes, count(*) FILTER (WHERE operation = 'error') AS dislikes, (SELECT string_agg(event_id, ',' ORDER BY place) FROM n WHERE n.topic = u.topic AND place <= 10) AS notes FROM u GROUP BY u.topic""")
def e23_feedback_notes(t: Tables) -> DataFrame:
    """Likes, dislikes and the last ten notes of each topic; what names none is "unknown"."""
    from athenaeum.operators.scoring import feedback

    context = F.when(F.col("event_id") % 4 == 0, F.lit('{"note": 1}')).otherwise(F.concat(F.lit('{"type": "topic '), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"), F.lit('"}')))
    verdict = F.when(F.col("operation") == "purchase", "like").when(F.col("operation") == "error", "dislike")
    made = feedback(t.usage.select(F.col("event_id").alias("id"), F.col("seen").alias("at"), context.alias("context"), verdict.alias("verdict")))
    return made.withColumn("notes", F.array_join(F.transform("notes", lambda n: n["id"].cast("string")), ","))


@query("""SELECT e.citing, 3 * count(*) FILTER (WHERE c.owned) + 2 * count(DISTINCT e.intent) - 5 * CAST(e.citing % 2 = 0 AS INTEGER) AS score FROM edges e JOIN cited c ON c.cited = e.cited GROUP BY e.citing ORDER BY score DESC, e.citing LIMIT 10""")
def e24_candidates(t: Tables) -> DataFrame:
    g = t.edges.join(t.cited, "cited").groupBy("citing").agg(F.count_if("owned").alias("o"), F.countDistinct("intent").alias("d"))
    return g.select("citing", (3 * F.col("o") + 2 * F.col("d") - 5 * (F.col("citing") % 2 == 0).cast("int")).alias("score")).orderBy(F.desc("score"), "citing").limit(10)


@query("""WITH k AS (SELECT unnest(['then', 'tion', 'que']) AS term), s AS (SELECT work_id, sum(CASE WHEN contains(lower(title), term) THEN 2 ELSE 0 END + CASE WHEN contains(lower(collection), term) THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), term) THEN 1 ELSE 0 END) AS points FROM works, k GROUP BY work_id)
 SELECT work_id, CAST(points AS BIGINT) AS points, round(points / (SELECT max(points) FROM s), 6) AS relevance FROM s WHERE points > 0""")
def e25_keyword_relevance(t: Tables) -> DataFrame:
    points = sum(2 * F.lower("title").contains(k).cast("long") + 3 * F.lower("collection").contains(k).cast("long") + F.lower("text").contains(k).cast("long") for k in ("then", "tion", "que"))
    s = t.works.select("work_id", points.alias("points")).filter("points > 0")
    top = F.broadcast(s.agg(F.max("points").alias("top")))  # one row
    return s.join(top).select("work_id", "points", r6(F.col("points") / F.col("top")).alias("relevance"))


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 0.5::DOUBLE), ('view', 0.1), ('purchase', 2.0)) v(operation, price))
 SELECT u.event_id, u.amount * p.price AS cost, round(sum(coalesce(u.amount * p.price, 0)) OVER (PARTITION BY user_id ORDER BY u.seen, u.event_id), 4) AS spent FROM usage u LEFT JOIN p ON p.operation = u.operation""")
def e28_running_cost(t: Tables) -> DataFrame:
    price = F.when(F.col("operation") == "click", 0.5).when(F.col("operation") == "view", 0.1).when(F.col("operation") == "purchase", 2.0)
    w = Window.partitionBy("user_id").orderBy("seen", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.col("amount") * price
    return t.usage.select("event_id", cost.alias("cost"), F.round(F.sum(F.coalesce(cost, F.lit(0.0))).over(w), 4).alias("spent"))


# windows, sorts, sets


@query("SELECT chapter, work_id, place FROM (SELECT chapter, work_id, row_number() OVER (PARTITION BY chapter ORDER BY quality DESC NULLS LAST, work_id) AS place FROM works) WHERE place <= 30")
def f1_top_per_chapter(t: Tables) -> DataFrame:
    return top_per_group(t.works, ["chapter"], [F.desc_nulls_last("quality"), F.asc("work_id")], 30).select("chapter", "work_id", "place")


@query("SELECT user_id, event_id, operation FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, event_id DESC) AS n FROM usage) WHERE n = 1")
def f2_latest_per_user(t: Tables) -> DataFrame:
    last = F.max_by(F.struct("event_id", "operation"), F.struct("seen", "event_id"))
    return t.usage.groupBy("user_id").agg(last.alias("x")).select("user_id", "x.event_id", "x.operation")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(seen AS DATE) AS day FROM usage), g AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS isle FROM d)
 SELECT user_id, max(n) AS longest, count(*) AS runs FROM (SELECT user_id, isle, count(*) AS n FROM g GROUP BY user_id, isle) GROUP BY user_id""")
def f3_day_streaks(t: Tables) -> DataFrame:
    days = t.usage.select("user_id", F.to_date("seen").alias("day")).distinct()
    isle = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    return days.withColumn("isle", isle).groupBy("user_id", "isle").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query("SELECT min(work_id) AS work_id, count(*) AS n FROM works GROUP BY CASE WHEN length(text) >= 100 THEN substr(text, 1, 100) ELSE text || chr(0) || work_id END")
def f4_first_seen(t: Tables) -> DataFrame:
    prefix = F.when(F.length("text") >= 100, F.substring("text", 1, 100)).otherwise(F.concat("text", F.lit("\0"), F.col("work_id").cast("string")))
    return t.works.groupBy(F.xxhash64(prefix).alias("h"), prefix.alias("p")).agg(F.min("work_id").alias("work_id"), F.count(F.lit(1)).alias("n")).select("work_id", "n")


@query("SELECT chapter, section, n FROM (SELECT chapter, section, n, row_number() OVER (PARTITION BY chapter ORDER BY n, section) AS place FROM (SELECT chapter, section, count(*) AS n FROM works WHERE status <> 'failed' GROUP BY 1, 2)) WHERE place = 1")
def f5_worst_per_chapter(t: Tables) -> DataFrame:
    n = t.works.filter("status <> 'failed'").groupBy("chapter", "section").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(n, ["chapter"], [F.asc("n"), F.asc("section")], 1).drop("place")


@query("SELECT min(fragment_id) AS fragment_id, work_id, text FROM fragments GROUP BY work_id, text")
def f6_collapse(t: Tables) -> DataFrame:
    return t.fragments.groupBy("work_id", "text").agg(F.min("fragment_id").alias("fragment_id"))


@query("SELECT work_id, quality FROM works ORDER BY quality ASC NULLS FIRST, work_id LIMIT 25")
def g1_order_limit(t: Tables) -> DataFrame:
    return t.works.select("work_id", "quality").orderBy(F.asc_nulls_first("quality"), "work_id").limit(25)


@query("SELECT cited, count(*) AS n, min(intent) AS intent FROM edges GROUP BY cited ORDER BY n DESC, cited LIMIT 20")
def g2_top_cited(t: Tables) -> DataFrame:
    return t.edges.groupBy("cited").agg(F.count(F.lit(1)).alias("n"), F.min("intent").alias("intent")).orderBy(F.desc("n"), "cited").limit(20)


@query("SELECT work_id, (SELECT count(*) FROM works WHERE quality IS NULL) AS remaining FROM works WHERE quality IS NULL AND work_id > 100 ORDER BY work_id LIMIT 20")
def g5_keyset_page(t: Tables) -> DataFrame:
    todo = t.works.filter(F.col("quality").isNull())
    left = F.broadcast(todo.agg(F.count(F.lit(1)).alias("remaining")))  # one row
    return todo.filter("work_id > 100").select("work_id").orderBy("work_id").limit(20).join(left)


@query("""SELECT work_id FROM (SELECT work_id, row_number() OVER (ORDER BY work_id) AS place FROM works WHERE status = 'pending') WHERE place <= greatest(0, 250 - (SELECT count(*) FROM works WHERE status = 'processing'))""")
def g6_daily_quota(t: Tables) -> DataFrame:
    used = F.broadcast(t.works.filter("status = 'processing'").agg(F.count(F.lit(1)).alias("used")))  # one row
    first = t.works.filter("status = 'pending'").select("work_id").orderBy("work_id").limit(250)
    return first.withColumn("place", F.row_number().over(Window.orderBy("work_id"))).join(used).filter(F.col("place") <= F.greatest(F.lit(0), 250 - F.col("used"))).select("work_id")


@query("SELECT work_id, priority FROM works WHERE status = 'pending' AND coalesce(flagged, 0) = 0 ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, work_id LIMIT 1")
def g7_next_in_queue(t: Tables) -> DataFrame:
    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    return t.works.filter((F.col("status") == "pending") & (F.coalesce("flagged", F.lit(0)) == 0)).orderBy(F.desc(rank), "work_id").limit(1).select("work_id", "priority")


@query("SELECT section, CASE section WHEN '1.1' THEN 1 WHEN '3.1' THEN 2 ELSE 9 END AS priority FROM (SELECT DISTINCT section FROM works) ORDER BY priority, section")
def g8_writing_order(t: Tables) -> DataFrame:
    return t.works.select("section").distinct().select("section", F.when(F.col("section") == "1.1", 1).when(F.col("section") == "3.1", 2).otherwise(9).alias("priority")).orderBy("priority", "section")


@query("SELECT work_id, length(substr(coalesce(nullif(trim(title), ''), text), 1, 1500)) AS n FROM works WHERE status = 'completed' ORDER BY n DESC, work_id LIMIT 5")
def g9_longest_preview(t: Tables) -> DataFrame:
    n = F.length(F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "text"), 1, 1500)).cast("long")
    return t.works.filter("status = 'completed'").select("work_id", n.alias("n")).orderBy(F.desc("n"), "work_id").limit(5)


@query("SELECT collection, work_id, used FROM (SELECT collection, work_id, CAST(sum(length(text)) OVER (PARTITION BY collection ORDER BY work_id) AS BIGINT) AS used FROM works) WHERE used <= 20000")
def g10_budget(t: Tables) -> DataFrame:
    """Works of each collection, in order, as far as a budget of characters goes.

    Sums run over chunks of a thousand ids first; only chunks that begin within the budget are looked into, so a collection's
    works are never sorted in one task.
    """
    sized = t.works.select("collection", "work_id", F.length("text").cast("long").alias("n"), F.floor(F.col("work_id") / 1000).alias("chunk"))
    before = Window.partitionBy("collection").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = sized.groupBy("collection", "chunk").agg(F.sum("n").alias("sum"))
    begun = chunks.select(F.col("collection").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")).filter("base <= 20000")
    some = sized.join(begun, F.col("collection").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    within = Window.partitionBy("collection", "chunk").orderBy("work_id").rowsBetween(Window.unboundedPreceding, 0)
    return some.select("collection", "work_id", (F.col("base") + F.sum("n").over(within)).alias("used")).filter("used <= 20000")


@query("SELECT doi, min(src) AS src FROM (SELECT doi, 0 AS src FROM works WHERE status = 'completed' AND doi IS NOT NULL UNION ALL SELECT doi, 1 FROM works WHERE doi IS NOT NULL) GROUP BY doi")
def i1_union_first(t: Tables) -> DataFrame:
    own = t.works.filter("status = 'completed' and doi is not null").select("doi", F.lit(0).alias("src"))
    return own.unionByName(t.works.filter("doi is not null").select("doi", F.lit(1).alias("src"))).groupBy("doi").agg(F.min("src").alias("src"))


@query("SELECT section FROM fragments INTERSECT SELECT section FROM works")
def i2_intersect(t: Tables) -> DataFrame:
    """One row for each section and task is dealt: sections are few, their rows are not."""
    sides = t.fragments.select("section", F.lit(1).alias("side")).union(t.works.select("section", F.lit(2)))
    return sides.groupBy("section").agg(F.min("side").alias("least"), F.max("side").alias("most")).filter("least < most").select("section")


@query("SELECT cited FROM cited EXCEPT SELECT cited FROM edges WHERE intent = 'method'")
def i3_difference(t: Tables) -> DataFrame:
    return t.cited.select("cited").exceptAll(t.edges.filter("intent = 'method'").select("cited").distinct())


@query("""WITH have AS (SELECT section, list_distinct(list(intent)) AS got FROM fragments WHERE relevance = 5 AND intent IS NOT NULL AND kind = 'summary' GROUP BY section)
 SELECT section, array_to_string(list_sort(list_filter(['method', 'extends', 'contrasts', 'result_comparison'], lambda x: NOT list_contains(got, x))), ',') AS missing FROM have""")
def i4_missing_intents(t: Tables) -> DataFrame:
    have = t.fragments.filter("relevance = 5 and kind = 'summary'").groupBy("section").agg(F.collect_set("intent").alias("got")).filter(F.size("got") > 0)
    expected = F.array(*map(F.lit, ("method", "extends", "contrasts", "result_comparison")))
    return have.select("section", F.array_join(F.array_sort(F.array_except(expected, "got")), ",").alias("missing"))


# graph


@query("SELECT count(*) AS links, count(DISTINCT e.cited) AS targets, count(*) FILTER (WHERE owned) AS internal, count(*) FILTER (WHERE NOT owned) AS external, round(count(*) / count(DISTINCT citing), 6) AS mean_refs FROM edges e JOIN cited c ON c.cited = e.cited")
def m1_graph_statistics(t: Tables) -> DataFrame:
    g = t.edges.join(t.cited.select("cited", "owned"), "cited")
    return g.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("cited").alias("targets"), F.count_if("owned").alias("internal"), F.count_if(~F.col("owned")).alias("external"), r6(F.count(F.lit(1)) / F.countDistinct("citing")).alias("mean_refs"))


@query("""SELECT * FROM (SELECT 'citing' AS side, citing AS id, count(DISTINCT cited) AS n FROM edges GROUP BY citing ORDER BY n DESC, id LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'cited' AS side, cited AS id, count(DISTINCT citing) AS n FROM edges GROUP BY cited ORDER BY n DESC, id LIMIT 10)""")
def m1_top_of_both_sides(t: Tables) -> DataFrame:
    """The ten works that cite most, and the ten that are cited most."""
    top = lambda side, other: t.edges.groupBy(F.col(side).alias("id")).agg(F.countDistinct(other).alias("n")).orderBy(F.desc("n"), "id").limit(10).select(F.lit(side).alias("side"), "id", "n")
    return top("citing", "cited").union(top("cited", "citing"))


@query("SELECT e.cited, count(DISTINCT e.citing) AS n FROM edges e WHERE e.citing IN (SELECT citing FROM edges WHERE cited = 7) AND e.cited <> 7 GROUP BY e.cited ORDER BY n DESC, e.cited LIMIT 20")
def m2_cocitation(t: Tables) -> DataFrame:
    citing = t.edges.filter("cited = 7").select("citing")
    return t.edges.join(citing, "citing", "left_semi").filter("cited <> 7").groupBy("cited").agg(F.countDistinct("citing").alias("n")).orderBy(F.desc("n"), "cited").limit(20)


@query("SELECT event_id, seen, event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) AS influenced_by FROM usage WHERE operation = 'purchase' ORDER BY seen, event_id")
def m3_decision_trail(t: Tables) -> DataFrame:
    return t.usage.filter("operation = 'purchase'").select("event_id", "seen", (F.col("event_id") - F.get_json_object("props", "$.k").cast("long")).alias("influenced_by")).orderBy("seen", "event_id")


@query("""WITH RECURSIVE d AS (SELECT event_id AS id, seen, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM usage WHERE operation = 'purchase'),
 l AS (SELECT DISTINCT d.id AS a, o.id AS b FROM d JOIN d o ON o.id IN (d.id - d.k, d.id - 3 * d.k, CASE WHEN d.k = 7 THEN d.id + 21 END) AND o.id <> d.id),
 r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT id, seen, (SELECT count(*) FROM l WHERE l.a = id) AS influences, count(b) AS rests_on, coalesce(string_agg(b, ',' ORDER BY b), '') AS trail FROM d LEFT JOIN r ON r.a = d.id AND r.b <> r.a GROUP BY id, seen""")
def m3_rests_on(t: Tables) -> DataFrame:
    """Each decision with all that it rests on, through its lists of influences; some lists point ahead and make cycles."""
    from athenaeum.operators.graph import trail

    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
    listed = F.to_json(F.filter(F.array(i - k, i - 3 * k, F.when(k == 7, i + 21)), lambda x: x.isNotNull()))
    made = trail(t.usage.filter("operation = 'purchase'").select(i.alias("id"), F.col("seen").alias("at"), listed.alias("influenced_by")))
    text = F.array_join(F.transform("rests_on", lambda x: x.cast("string")), ",")
    return made.select("id", F.col("at").alias("seen"), F.size("influences").cast("long").alias("influences"), F.size("rests_on").cast("long").alias("rests_on"), text.alias("trail"))


@query("""WITH RECURSIVE up(node, parent, depth) AS (SELECT section, section, 0 FROM (SELECT DISTINCT section || '.1' AS section FROM works) UNION ALL
 SELECT node, regexp_replace(parent, '\\.[^.]*$', ''), depth + 1 FROM up WHERE contains(parent, '.')) SELECT node, parent, depth FROM up""")
def m4_ancestors(t: Tables) -> DataFrame:
    """Every node with all its ancestors: a dotted id holds its whole chain, so no walk is needed."""
    nodes = t.works.select(F.concat("section", F.lit(".1")).alias("node")).distinct()
    parts = F.split("node", r"\.")
    return nodes.select("node", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n")).select("node", F.array_join(F.slice(parts, 1, F.col("n")), ".").alias("parent"), (F.size(parts) - F.col("n")).alias("depth"))
