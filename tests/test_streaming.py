"""Streams read to their end give the batch result."""

import pytest
from pyspark.sql import functions as F

from docreview.operators import state as W
from docreview.streaming import state as S


@pytest.fixture(scope="module")
def events(spark, sf, tmp_path_factory):
    """Events written as three files in order of time, and the same rows as a table."""
    root = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value",
        F.col("ts").cast("timestamp").alias("ts"))
    low, high = rows.select(F.percentile("id", 0.33), F.percentile("id", 0.66)).first()
    for i, part in enumerate((f"id <= {low}", f"id > {low} and id <= {high}", f"id > {high}")):
        rows.filter(part).coalesce(1).write.parquet(f"{root}/part{i}")
    return root, spark.read.parquet(*[f"{root}/part{i}" for i in range(3)])


def read_stream(spark, events):
    root, table = events
    return spark.readStream.schema(table.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(root)


def finish(df, tmp_path, mode, spark, **trigger):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def write(batch, batch_id):
        batch.withColumn("batch_no", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(**trigger or {"availableNow": True}).foreachBatch(write).start().awaitTermination(60)
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_history(spark, events, tmp_path):
    got = finish(S.stream_bounded_history(read_stream(spark, events), 4), tmp_path, "update", spark)
    last = got.join(got.groupBy("key").agg(F.max("batch_no").alias("batch_no")), ["key", "batch_no"]).select("key", "id", "age")
    table = events[1].withColumn("kind", F.lit("all"))
    assert rows(last) == rows(W.bounded_history(table, {"all": 4}).select("key", "id", "age"))


def test_admission(spark, events, tmp_path):
    got = finish(S.stream_admission(read_stream(spark, events), 3, 86_400), tmp_path, "append", spark).drop("batch_no")
    assert rows(got) == rows(W.admit_requests(events[1], 3, 86_400))


def test_ttl_store(spark, events, tmp_path):
    to_puts = lambda df: df.select("kind", "key", "value", F.col("ts").alias("updated_at"), "id").select(
        F.concat(F.lit("feedback/"), "kind").alias("namespace"), "key", "value", "updated_at",
        F.when(F.col("value") < 1, "delete").otherwise("put").alias("op"))
    got = finish(S.stream_ttl_store(to_puts(read_stream(spark, events)), 10_000), tmp_path, "update", spark, once=True)
    last = got.groupBy("namespace", "key").agg(F.max_by(F.struct("value", "op"), "batch_no").alias("r")).select("namespace", "key", "r.*")
    live = last.filter("op = 'put'").select("namespace", "key", "value")
    batch = W.ttl_store(to_puts(events[1]), F.lit("2030-01-01"), 0, 10 ** 6, 10 ** 6).select("namespace", "key", "value")
    assert rows(live) == rows(batch)


def test_running_metrics(spark, events, tmp_path):
    stream = S.stream_running_metrics(read_stream(spark, events).withColumnRenamed("kind", "status"))
    got = finish(stream, tmp_path, "complete", spark)
    last = got.filter(F.col("batch_no") == got.agg(F.max("batch_no")).first()[0]).drop("batch_no")
    want = W.running_metrics(events[1].withColumnRenamed("kind", "status")).filter("status <> 'all'")
    assert rows(last.select("status", "n", "avg_value")) == rows(want.select("status", "n", "avg_value"))


def test_latest_status(spark, events, tmp_path):
    outcome = {"purchase": "completed", "error": "failed"}
    out = str(tmp_path / "out")
    S.stream_latest_status(read_stream(spark, events), outcome).writeStream.outputMode("update").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(S.upsert_to(out)).start().awaitTermination()
    got = S.read_upserts(spark, out).select("key", "status", "updated_at")
    assert rows(got) == rows(W.latest_status(events[1], outcome).select("key", "status", "updated_at"))


def test_dedupe(spark, events, tmp_path):
    twice = read_stream(spark, events).select("id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    got = finish(S.stream_dedupe(twice), tmp_path, "append", spark)
    assert got.count() == events[1].count() == got.select("id").distinct().count()


def last_mark(events, late):
    """The watermark after the last file: windows that end by then are closed."""
    return F.lit(events[1].agg(F.max("ts") - F.expr(f"INTERVAL {late}")).first()[0])


def test_windows_close(spark, events, tmp_path):
    stream = S.stream_metrics_window(read_stream(spark, events).withColumnRenamed("kind", "status"), "1 day")
    got = finish(stream, tmp_path, "append", spark).drop("batch_no")
    want = events[1].groupBy(F.window("ts", "1 day").alias("w"), F.col("kind").alias("status")).agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("avg_value"))
    want = want.filter(F.col("w.end") <= last_mark(events, "10 minutes"))
    assert rows(got) == rows(want.select("w.start", "status", "n", "avg_value")) != []


def test_request_rate_and_silent_runs(spark, events, tmp_path):
    rate = finish(S.stream_request_rate(read_stream(spark, events), "1 day", "6 hours"), tmp_path / "a", "append", spark)
    want = events[1].groupBy(F.window("ts", "1 day", "6 hours").end.alias("window_end"), "key").agg(F.count("*").alias("rate"))
    want = want.filter(F.col("window_end") <= last_mark(events, "60 seconds"))
    assert rows(rate.drop("batch_no")) == rows(want) != []
    silent = finish(S.stream_silent_runs(read_stream(spark, events)), tmp_path / "b", "append", spark).drop("batch_no")
    want = events[1].groupBy(F.session_window("ts", "900 seconds").alias("w"), "key").agg(F.count("*").alias("n"))
    want = want.filter(F.col("w.end") <= last_mark(events, "60 seconds")).select("key", "w.start", "w.end", "n")
    assert rows(silent) == rows(want) != []
