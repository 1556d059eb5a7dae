"""Streams against their batch forms."""

from pyspark.sql import functions as F

from sparkreef.operators import alerts, folds
from sparkreef.streaming import alerts as stream_alerts
from sparkreef.streaming import digest, limits


def arrivals(spark, folder, table, parts, key):
    source = spark.read.parquet(table)
    for i in range(parts):
        source.where(F.col(key) % parts == i).coalesce(1).write.mode("append").parquet(folder)
    return source, lambda: spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_digest_gives_each_key_once_over_several_runs(spark, small, tmp_path):
    folder = str(tmp_path / "in")
    docs, stream = arrivals(spark, folder, f"{small}/documents.parquet", 3, "doc_id")
    places = [str(tmp_path / x) for x in ("out", "state", "checkpoint")]
    keyed = lambda df: df.select("doc_id", F.md5("text").alias("key"))
    digest.run_digest(keyed(stream()), "key", "doc_id", *places).awaitTermination(120)
    docs.limit(20).coalesce(1).write.mode("append").parquet(folder)
    digest.run_digest(keyed(stream()), "key", "doc_id", *places).awaitTermination(120)
    found = [r.key for r in spark.read.parquet(places[0]).collect()]
    assert sorted(found) == sorted(r.key for r in keyed(docs).select("key").distinct().collect())


def test_alert_states_follow_the_batch_form(spark, small, tmp_path):
    folder = str(tmp_path / "events")
    events, stream = arrivals(spark, folder, f"{small}/events.parquet", 1, "event_id")
    condition = F.col("value") > 30
    changed = stream_alerts.held_alerts(stream(), "user_id", "ts", condition, 21_600)
    query = changed.writeStream.format("memory").queryName("held").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    held = alerts.holds(events, ["user_id"], "ts", "event_id", condition, 21_600)
    micros = F.unix_micros(F.col("since").cast("timestamp"))
    begun = {(str(r.user_id), r.m) for r in held.select("user_id", micros.alias("m")).collect()}
    rows = spark.table("held").collect()
    assert {(r.series, r["at"]) for r in rows if r.state == "pending"} == begun
    assert sum(r.state == "firing" for r in rows) == held.where("state = 'firing'").count()


def test_windows_on_a_stream(spark, small, tmp_path):
    folder = str(tmp_path / "events")
    events, stream = arrivals(spark, folder, f"{small}/events.parquet", 1, "event_id")
    counted = digest.windowed_counts(stream(), "ts", "event_type", "1 day", "2 days")
    counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    batch = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count()
    assert sorted(r.n for r in spark.table("counts").collect()) == sorted(r["count"] for r in batch.collect())


def test_token_buckets_follow_the_batch_form(spark, small, tmp_path):
    """Over several batches the stream lets the same requests pass as one fold over all of them."""
    folder = str(tmp_path / "requests")
    events = spark.read.parquet(f"{small}/events.parquet")
    third = events.count() // 3 + 1
    for i in range(3):  # in order of time, as requests arrive
        events.where((F.col("event_id") >= i * third) & (F.col("event_id") < (i + 1) * third)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    told = limits.token_bucket(stream, "user_id", "ts", "event_id", 3, 14_400)
    query = told.writeStream.format("memory").queryName("passed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    seconds = events.withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    batch = folds.token_bucket(seconds, ["user_id"], "s", ["ts", "event_id"], 3, 14_400)
    found = {r.unique: r.passed for r in spark.table("passed").collect()}
    assert found == {r.event_id: r.passed for r in batch.collect()} and set(found.values()) == {True, False}
