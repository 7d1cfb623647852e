"""Writes: each plan gives the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from athenaeum.operators import merge
from athenaeum.plans.registry import query
from athenaeum.sources.tables import Tables

STATES = "SELECT work_id, status, quality FROM works WHERE work_id % 2 = 0"
UPDATES = "SELECT work_id, CASE WHEN work_id % 3 = 0 THEN 'pending' WHEN work_id % 3 = 1 THEN '' END AS status, CASE WHEN work_id % 4 = 0 THEN 2 END AS quality FROM works WHERE work_id % 5 < 3"


def _old(t: Tables) -> DataFrame:
    return t.works.filter("work_id % 2 = 0").select("work_id", "status", "quality")


def _new(t: Tables) -> DataFrame:
    return t.works.filter("work_id % 5 < 3").select("work_id", F.when(F.col("work_id") % 3 == 0, "pending").when(F.col("work_id") % 3 == 1, "").alias("status"), F.when(F.col("work_id") % 4 == 0, 2).alias("quality"))


@query(f"WITH o AS ({STATES}), n AS ({UPDATES}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE work_id NOT IN (SELECT work_id FROM o)")
def b1_insert_ignore(t: Tables) -> DataFrame:
    return merge.insert_ignore(_old(t), _new(t), ["work_id"])


@query("SELECT citing, h, intent FROM (SELECT citing, md5(lower(trim(c.title))) AS h, intent, row_number() OVER (PARTITION BY citing, md5(lower(trim(c.title))) ORDER BY line DESC, intent DESC) AS n FROM edges e JOIN cited c ON c.cited = e.cited) WHERE n = 1")
def b2_insert_replace(t: Tables) -> DataFrame:
    links = t.edges.join(t.cited.select("cited", "title"), "cited").select("citing", F.md5(F.lower(F.trim("title"))).alias("h"), "line", "intent")
    return merge.insert_replace(links.filter("line <= 3"), links.filter("line > 3"), ["citing", "h"], ["line", "intent"]).select("citing", "h", "intent")


@query(f"WITH o AS ({STATES}), n AS ({UPDATES}) SELECT coalesce(o.work_id, n.work_id) AS work_id, CASE WHEN o.work_id IS NULL THEN n.status ELSE coalesce(nullif(n.status, ''), o.status) END AS status, coalesce(n.quality, o.quality) AS quality FROM o FULL JOIN n ON n.work_id = o.work_id")
def b3_upsert_preserve(t: Tables) -> DataFrame:
    return merge.upsert(_old(t), _new(t), ["work_id"], {"status": merge.fill_text, "quality": merge.fill})


@query(f"""WITH o AS ({STATES}), n AS ({UPDATES}) SELECT coalesce(o.work_id, n.work_id) AS work_id, CASE WHEN o.work_id IS NULL THEN n.status WHEN n.work_id IS NULL THEN o.status WHEN n.status = 'pending' THEN coalesce(n.status, o.status) END AS status,
 CASE WHEN n.work_id IS NULL THEN o.quality ELSE n.quality END AS quality FROM o FULL JOIN n ON n.work_id = o.work_id""")
def b4_case_provenance(t: Tables) -> DataFrame:
    judged = lambda old, new: F.when(new == "pending", F.coalesce(new, old))
    return merge.upsert(_old(t), _new(t), ["work_id"], {"status": judged})


@query("SELECT work_id, section, 'new' AS origin FROM works WHERE work_id % 2 = 0 UNION ALL SELECT work_id, section, 'old' FROM fragments WHERE work_id NOT IN (SELECT work_id FROM works WHERE work_id % 2 = 0)")
def b5_replace_partitions(t: Tables) -> DataFrame:
    old = t.fragments.select("work_id", "section", F.lit("old").alias("origin"))
    new = t.works.filter("work_id % 2 = 0").select("work_id", "section", F.lit("new").alias("origin"))
    return merge.replace_partitions(old, new, ["work_id"])


@query("SELECT CAST(seen AS DATE) AS day, count(*) AS n, round(sum(amount), 4) AS total FROM usage GROUP BY 1")
def b6_daily_counters(t: Tables) -> DataFrame:
    return t.usage.groupBy(F.to_date("seen").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@query("SELECT fragment_id, chapter = 2 AND work_id NOT IN (SELECT work_id FROM works WHERE status = 'completed') AS stale FROM fragments")
def b7_mark_stale(t: Tables) -> DataFrame:
    live = t.works.filter("status = 'completed'").select("work_id")
    return merge.mark_missing(t.fragments.withColumn("stale", F.lit(False)), live, F.col("chapter") == 2, "work_id", "stale").select("fragment_id", "stale")


@query("SELECT fragment_id, CASE WHEN work_id % 10 = 3 THEN work_id + 100000 ELSE work_id END AS work_id FROM fragments WHERE work_id % 10 <> 4")
def b8_cascade_rename_delete(t: Tables) -> DataFrame:
    ids = t.fragments.select("work_id").distinct()
    renames = ids.filter("work_id % 10 = 3").select(F.col("work_id").alias("old_id"), (F.col("work_id") + 100000).alias("new_id"))
    gone = ids.filter("work_id % 10 = 4").select("work_id")
    return merge.rename_keys(merge.delete(t.fragments.select("fragment_id", "work_id"), gone, "work_id"), renames, "work_id")


@query("SELECT work_id, coalesce(quality, CASE WHEN chapter IN (1, 2, 3) THEN chapter END) AS quality FROM works")
def b10_first_valid_backfill(t: Tables) -> DataFrame:
    return t.works.select("work_id", merge.backfill((1, 2, 3))(F.col("quality"), F.col("chapter")).alias("quality"))


@query("""WITH o AS (SELECT work_id, list_sort(list_distinct(list(section))) AS s FROM fragments WHERE relevance >= 4 GROUP BY 1), n AS (SELECT work_id, list_sort(list_distinct(list(section))) AS s FROM fragments WHERE relevance >= 4 AND (work_id % 4 <> 1 OR kind IS NULL) AND work_id % 9 <> 0 GROUP BY 1)
 SELECT coalesce(o.work_id, n.work_id) AS work_id, CASE WHEN o.work_id IS NULL THEN 'new' WHEN n.work_id IS NULL THEN 'gone' WHEN o.s = n.s THEN 'unchanged' ELSE 'updated' END AS state FROM o FULL JOIN n ON n.work_id = o.work_id""")
def b11_sync_diff(t: Tables) -> DataFrame:
    sets = lambda df: df.groupBy("work_id").agg(F.array_sort(F.collect_set("section")).alias("s"))
    f = t.fragments.filter("relevance >= 4")
    return merge.diff(sets(f), sets(f.filter("(work_id % 4 <> 1 or kind is null) and work_id % 9 <> 0")), "work_id", ["s"])


@query("SELECT citing AS work_id, max(line) AS active_run FROM edges WHERE intent <> 'background' GROUP BY 1")
def b12_publish_pointer(t: Tables) -> DataFrame:
    runs = t.edges.select(F.col("citing").alias("work_id"), F.col("line").alias("run_id"), F.when(F.col("intent") != "background", "published").otherwise("pending").alias("state"))
    return merge.publish(runs)


@query("SELECT w.work_id, m.id AS server_id FROM works w JOIN (SELECT lower(doi) AS doi, min(work_id) AS id FROM works WHERE doi IS NOT NULL GROUP BY 1) m ON m.doi = lower(w.doi) WHERE w.year >= 2000")
def b14_id_remap(t: Tables) -> DataFrame:
    m = t.works.filter("doi is not null").groupBy(F.lower("doi").alias("k")).agg(F.min("work_id").alias("server_id"))
    return t.works.filter("year >= 2000").withColumn("k", F.lower("doi")).join(m, "k").select("work_id", "server_id")


@query("SELECT user_id, min_by(event_id, (seen, event_id)) AS chosen FROM usage WHERE operation IN ('purchase', 'signup') GROUP BY user_id")
def p2_write_once(t: Tables) -> DataFrame:
    return t.usage.filter(F.col("operation").isin("purchase", "signup")).groupBy("user_id").agg(F.min_by("event_id", F.struct("seen", "event_id")).alias("chosen"))


@query("SELECT user_id, last(operation ORDER BY seen, event_id) AS status, string_agg(DISTINCT operation, ',' ORDER BY operation) FILTER (WHERE operation <> 'view') AS steps FROM usage GROUP BY user_id")
def p3_status_machine(t: Tables) -> DataFrame:
    steps = F.array_join(F.array_sort(F.collect_set(F.when(F.col("operation") != "view", F.col("operation")))), ",")
    return t.usage.groupBy("user_id").agg(F.max_by("operation", F.struct("seen", "event_id")).alias("status"), steps.alias("steps"))


@query("SELECT work_id, CASE WHEN status IN ('failed', 'skipped', 'processing') THEN 'pending' ELSE status END AS status FROM works")
def p4_reset_for_retry(t: Tables) -> DataFrame:
    return t.works.select("work_id", F.when(F.col("status").isin("failed", "skipped", "processing"), "pending").otherwise(F.col("status")).alias("status"))


@query("SELECT fragment_id, CASE WHEN kind = 'summary' THEN NULL ELSE coalesce(CASE WHEN relevance = 5 THEN 'p. 5' END, section) END AS locator FROM fragments")
def p5_provenance(t: Tables) -> DataFrame:
    given = F.when(F.col("relevance") == 5, "p. 5")
    return t.fragments.select("fragment_id", F.when(F.col("kind") == "summary", None).otherwise(F.coalesce(given, "section")).alias("locator"))


@query("SELECT fragment_id FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.citing = f.work_id AND e.cited % 7 + 1 = f.chapter AND e.intent = f.intent)")
def p6_skip_list(t: Tables) -> DataFrame:
    skips = t.edges.select(F.col("citing").alias("work_id"), (F.col("cited") % 7 + 1).cast("int").alias("chapter"), "intent")
    return t.fragments.join(skips, ["work_id", "chapter", "intent"], "left_anti").select("fragment_id")


@query("SELECT w.work_id, coalesce(string_agg(DISTINCT f.section, ',' ORDER BY f.section), w.section) AS sections FROM works w LEFT JOIN fragments f ON f.work_id = w.work_id AND f.relevance = 5 GROUP BY w.work_id, w.section")
def p7_assigned_or_primary(t: Tables) -> DataFrame:
    f = t.fragments.filter("relevance = 5").groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("s"))
    return t.works.select("work_id", "section").join(f, "work_id", "left").select("work_id", F.coalesce("s", "section").alias("sections"))


@query("SELECT work_id, count(*) AS n FROM fragments WHERE work_id NOT IN (SELECT work_id FROM works WHERE coalesce(flagged, 0) = 1) GROUP BY work_id")
def p8_cascade_delete(t: Tables) -> DataFrame:
    return merge.delete(t.fragments, t.works.filter("flagged = 1").select("work_id"), "work_id").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(seen AS DATE) AS day, max_by(event_id, (seen, event_id)) AS plan FROM usage WHERE operation = 'click' GROUP BY 1")
def p17_plan_per_day(t: Tables) -> DataFrame:
    return t.usage.filter("operation = 'click'").groupBy(F.to_date("seen").alias("day")).agg(F.max_by("event_id", F.struct("seen", "event_id")).alias("plan"))


@query("SELECT w.work_id, CASE WHEN w.work_id % 3 = 0 THEN 'patched' ELSE w.status END AS status, w.quality FROM works w")
def p18_partial_patch(t: Tables) -> DataFrame:
    patch = t.works.filter("work_id % 3 = 0").select("work_id", F.lit("patched").alias("status"), F.lit(None).cast("int").alias("quality"))
    return merge.upsert(t.works.select("work_id", "status", "quality"), patch, ["work_id"], {"status": merge.fill, "quality": merge.fill})


@query("""SELECT f AS field, a, b, a = b AS equal FROM (SELECT unnest(['title', 'year', 'doi', 'quality']) AS f, unnest([count(title), count(year), count(doi), count(quality)]) AS a, unnest([count(title) FILTER (WHERE work_id % 7 <> 0 OR year IS NULL), count(year) FILTER (WHERE work_id % 7 <> 0 OR year IS NULL), count(doi) FILTER (WHERE work_id % 7 <> 0 OR year IS NULL), count(quality) FILTER (WHERE work_id % 7 <> 0 OR year IS NULL)]) AS b FROM works)""")
def p19_reconciliation(t: Tables) -> DataFrame:
    fields = ("title", "year", "doi", "quality")
    moved = (F.col("work_id") % 7 != 0) | F.col("year").isNull()
    counts = t.works.agg(*[F.count(c).alias(f"a_{c}") for c in fields], *[F.count(F.when(moved, F.col(c))).alias(f"b_{c}") for c in fields])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in fields])
    return counts.select(F.inline(rows)).withColumn("equal", F.col("a") == F.col("b"))
