from pyspark.sql import functions as F

from athenaeum.sources.files import read_current
from athenaeum.streaming import events

FOLDER = "/root/testdata/sf0.001/events.parquet"


def split(spark, tmp_path):
    """The events in files by day, so that triggers see them in order."""
    e = spark.read.parquet(FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    whole = e.orderBy("ts")
    for i, (a, b) in enumerate(((1, 8), (8, 16), (16, 32))):
        whole.filter((F.dayofmonth("ts") >= a) & (F.dayofmonth("ts") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e


def drain(df, mode, name, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    e = split(spark, tmp_path)
    source = lambda: events.stream(spark, str(tmp_path / "in"))
    pick = lambda df: sorted(map(tuple, df.select("start", "event_type", "n").collect()))
    assert pick(drain(events.tumbling(source()), "complete", "tumbling", spark, tmp_path)) == pick(events.tumbling(e))
    sent = drain(events.limiter(source()), "append", "limited", spark, tmp_path)
    assert sorted(map(tuple, sent.collect())) == sorted(map(tuple, events.limiter(e).collect()))


def test_sessions_agree_with_the_batch(spark, tmp_path):
    """All sessions but those that may still grow when the stream ends; the batch has those too."""
    e = split(spark, tmp_path)
    pick = lambda df: {(r.user_id, r.start, r.end, r.n) for r in df.collect()}
    sent = pick(drain(events.sessions(events.stream(spark, str(tmp_path / "in"))), "append", "sessions", spark, tmp_path))
    whole = pick(events.sessions(e))
    last = e.agg(F.max("ts")).first()[0]
    assert sent <= whole and all((last - r[2]).total_seconds() < 3600 for r in whole - sent) and len(sent) > 100


def test_repeats_within_the_watermark_count_once(spark, tmp_path):
    e = spark.read.parquet(FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    e.unionByName(e.filter("event_id % 3 = 0")).orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    sent = drain(events.deduplicated(events.stream(spark, str(tmp_path / "in"))), "append", "once", spark, tmp_path)
    ids = [r.event_id for r in sent.select("event_id").collect()]
    assert len(ids) == len(set(ids)) == e.count() == events.deduplicated(e.unionByName(e)).count()


def test_limiter_of_a_user_whose_calls_fill_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        calls = spark.range(100).selectExpr("id AS event_id", "timestamp_seconds(id * 600) AS ts", "id % 2 AS user_id")
        got = {r.event_id: r.allowed for r in events.limiter(calls, most=2, seconds=3600.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # every third call of a user falls within an hour of two that were let through
    assert [got[i] for i in range(0, 24, 2)] == [True, True, False] * 4


def test_merge_each(spark, tmp_path):
    e = split(spark, tmp_path)
    root = f"file://{tmp_path}/table"
    events.merge_each(events.stream(spark, str(tmp_path / "in"), 1), root, str(tmp_path / "check")).start().awaitTermination(120)
    want = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("x"))
    assert dict(read_current(spark, root).select("user_id", "event_id").collect()) == dict(want.collect())


def test_limiter_rule():
    times = []
    assert [events._limit(times, t, 2, 10.0) for t in (0, 1, 2, 9.5, 10.0, 10.5, 11.0)] == [True, True, False, False, True, False, True]


def test_sliding_windows_agree_with_the_batch_and_drop_what_is_late(spark, tmp_path):
    """Each window is the sum of its panes; what comes later than the watermark is in no window of the stream."""
    e = split(spark, tmp_path)
    late = e.filter("event_id < 5").withColumn("event_id", F.col("event_id") + 10_000)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pick = lambda df: {(r.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect()}
    sent = pick(drain(events.sliding(events.stream(spark, str(tmp_path / "in"))), "append", "slid", spark, tmp_path))
    whole = pick(events.sliding(e))
    last = e.agg(F.max("ts")).first()[0]
    assert sent <= whole and all((last - r[0]).total_seconds() < 2 * 3600 + 900 for r in whole - sent) and len(sent) > 1000
    direct = e.groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert pick(direct.select("window.start", "event_type", "n", "total")) == whole


def test_runs_are_given_up_by_timers(spark, tmp_path):
    """The stream's timers fail the runs that the batch fails, all but those whose time the watermark hasn't reached."""
    from athenaeum.streaming.runs import given_up

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = split(spark, tmp_path)
        said = lambda df: df.select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), F.when(F.col("event_type").isin("view", "click"), "running").otherwise(F.col("event_type")).alias("state"))
        pick = lambda df: sorted((r.run_id, r["at"].replace(microsecond=r["at"].microsecond // 1000 * 1000), r.state) for r in df.collect())
        sent = pick(drain(given_up(said(events.stream(spark, str(tmp_path / "in")))), "append", "runs", spark, tmp_path))
        whole, last = given_up(said(e)), e.agg(F.max("ts")).first()[0]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = pick(whole)
    assert set(sent) <= set(want) and len(sent) == len(set(sent)) and sum(r[2] == "failed" for r in sent) > 100
    assert all(r[2] == "failed" and (last - r[1]).total_seconds() < 700 for r in set(want) - set(sent))


def test_calls_without_a_user_are_nobody_elses(spark):
    calls = spark.range(30).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0L ELSE -1L END AS user_id")
    got = events.limiter(calls, most=2, seconds=3600.0).collect()
    assert {r.event_id: r.user_id for r in got} == {i: (None, 0, -1)[i % 3] for i in range(30)}
    assert sorted(r.event_id for r in got if r.allowed) == [0, 1, 2, 3, 4, 5]
