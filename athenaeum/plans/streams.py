"""Batch twins of the streaming operators; tests run every stream against its twin."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from athenaeum.plans.registry import query
from athenaeum.sources.tables import Tables
from athenaeum.streaming import events


def _events(t: Tables) -> DataFrame:
    return t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def n0_tumbling_counts(t: Tables) -> DataFrame:
    return events.tumbling(_events(t)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS start, event_type, value FROM events) GROUP BY 1, 2""")
def n0_sliding_counts(t: Tables) -> DataFrame:
    """Windows of an hour that begin every quarter, as sums of quarters."""
    return events.sliding(_events(t)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def n0_sessions(t: Tables) -> DataFrame:
    s = events.sessions(_events(t))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT event_id, user_id, n, true AS allowed, [ts] AS times FROM o WHERE n = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.n, len(list_filter(r.times, lambda x: x > o.ts - INTERVAL 1 HOUR)) < 2,
   CASE WHEN len(list_filter(r.times, lambda x: x > o.ts - INTERVAL 1 HOUR)) < 2 THEN list_append(list_filter(r.times, lambda x: x > o.ts - INTERVAL 1 HOUR), o.ts) ELSE list_filter(r.times, lambda x: x > o.ts - INTERVAL 1 HOUR) END
  FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
 SELECT event_id, user_id, allowed FROM r""")
def n1_rate_limiter(t: Tables) -> DataFrame:
    return events.limiter(_events(t))


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 10:00:00' - INTERVAL 2 HOUR THEN 'failed' ELSE event_type END AS state FROM events")
def n2_stale_work(t: Tables) -> DataFrame:
    limit = F.lit(datetime.datetime(2024, 1, 15, 8)).cast("timestamp_ntz")
    return t.raw("events").select("event_id", F.when((F.col("event_type") == "view") & (F.col("ts") < limit), "failed").otherwise(F.col("event_type")).alias("state"))


@query("""WITH m AS (SELECT user_id AS run_id, ts AS "at", CASE WHEN event_type IN ('view', 'click') THEN 'running' ELSE event_type END AS state FROM events),
 n AS (SELECT *, lead("at") OVER (PARTITION BY run_id ORDER BY "at", state) AS following, max("at") OVER () AS last FROM m)
 SELECT run_id, "at", state FROM m UNION ALL SELECT run_id, "at" + INTERVAL 2 HOUR, 'failed' FROM n WHERE state = 'running' AND coalesce(following, last) >= "at" + INTERVAL 2 HOUR""")
def n2_given_up(t: Tables) -> DataFrame:
    """Runs' messages, and the time at which each run that never ended is given up; the stream does it by timers."""
    from athenaeum.streaming.runs import given_up

    state = F.when(F.col("event_type").isin("view", "click"), "running").otherwise(F.col("event_type"))
    made = given_up(_events(t).select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), state.alias("state")))
    return made.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events")
def n3_replay(t: Tables) -> DataFrame:
    """A day's events sent twice count once."""
    e = _events(t)
    return events.deduplicated(e.unionByName(e.filter("event_id % 3 = 0"))).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def n4_incremental_pull(t: Tables) -> DataFrame:
    return t.raw("events").filter(F.col("ts") >= F.lit(datetime.datetime(2024, 1, 20)).cast("timestamp_ntz")).select("event_id")


@query("SELECT md5(count(*) || ':' || coalesce(sum(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 12) AS BIGINT)), 0) || ':' || coalesce(sum(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 13, 12) AS BIGINT)), 0)) AS state FROM (SELECT DISTINCT user_id FROM events)")
def n5_state_key(t: Tables) -> DataFrame:
    """What a cached result is kept under: equal sets of users give equal keys. Sums of hashes need no order and no gathering."""
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(F.md5(F.col("user_id").cast("string")), at, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return t.usage.select("user_id").distinct().agg(F.md5(F.concat_ws(":", F.count(F.lit(1)).cast("string"), part(1), part(13))).alias("state"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1), h AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 2 = 0 GROUP BY 1)
 SELECT unnest(['made', 'kept']) AS how, event_type, n, total FROM g UNION ALL SELECT 'made anew', event_type, n, total FROM h""")
def n5_cached_counts(t: Tables) -> DataFrame:
    """A result made once and read twice, then made anew for another state of what it rests on."""
    from athenaeum.operators.cache import Results, state_key
    from athenaeum.operators.shared import fresh_path

    cache, out = Results(t.spark, fresh_path(t.spark, "results")), None
    for how, rows in (("made", t.raw("events")), ("kept", t.raw("events")), ("made anew", t.raw("events").filter("event_id % 2 = 0"))):
        counts = lambda rows=rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        found, there = cache.get("user", "project", state_key(rows, "event_id", "event_type", "value"), "", "counts", counts)
        told = found.select(F.lit(how if there is (how == "kept") else "wrong").alias("how"), "event_type", "n", "total")
        out = told if out is None else out.union(told)
    return out


@query("""WITH j AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 'finished' WHEN value <= 50 THEN 'queued' WHEN ts < TIMESTAMP '2024-01-15 10:00:00' - INTERVAL 300 SECOND THEN 'timed out' ELSE 'running' END AS state FROM events)
 SELECT event_id, state, CASE WHEN state = 'queued' THEN row_number() OVER (PARTITION BY user_id, state ORDER BY ts, event_id) END AS place FROM j""")
def n6_job_states(t: Tables) -> DataFrame:
    """What of a job queue is data: each job's state (a running one is given up after 300 seconds) and its place in its user's queue."""
    limit = F.lit(datetime.datetime(2024, 1, 15, 9, 55)).cast("timestamp_ntz")
    state = F.when(F.col("event_type") == "purchase", "finished").when(F.col("value") <= 50, "queued").when(F.col("ts") < limit, "timed out").otherwise("running")
    jobs = t.raw("events").select("event_id", "user_id", "ts", state.alias("state"))
    place = F.row_number().over(Window.partitionBy("user_id", "state").orderBy("ts", "event_id"))
    return jobs.select("event_id", "state", F.when(F.col("state") == "queued", place).cast("long").alias("place"))
