"""Streams that keep state, against plain models and batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkreef.operators import folds
from sparkreef.sources import manifests
from sparkreef.streaming import admission, cadence, conflation, progress

DAY = dt.datetime(2026, 1, 6)


@pytest.fixture
def stored(spark):
    with admission.state_store(spark):
        yield spark


def batches(spark, folder, parts, schema):
    """A stream that has one part a trigger; files are dealt out by when they were written."""
    import os

    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for name in os.listdir(f"{folder}/{i:03d}"):
            os.utime(f"{folder}/{i:03d}/{name}", (1_000_000 + i * 100, 1_000_000 + i * 100))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def collected(df, name, mode, checkpoint):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(checkpoint)).start().awaitTermination(240)
    return df.sparkSession.table(name).collect()


def hour(h):
    return DAY + dt.timedelta(hours=h)


def model(parts, budget, look_back):
    """Runs over whole lists: what is sent, what waits, and all cutoffs behind each run."""
    known, waiting, cutoffs, told = set(), [], {}, []
    for rows in parts:
        ended = {}
        for _, source, key, at, ok in rows:
            if key is None:
                ended[source] = ok
        now = max(at for _, _, key, at, _ in rows if key is None)
        best = {}
        for _, source, key, at, _ in rows:
            if key is not None and key not in known:
                cut = cutoffs.get(source, now - look_back)
                order = (at is not None, at or DAY, source)
                if key not in best or order < best[key][0]:
                    best[key] = (order, source, at, cut)
        fresh = [(s, k, a) for k, (_, s, a, cut) in best.items() if a is None or a >= cut]
        known |= {k for _, k, _ in fresh}
        ready = sorted(waiting + fresh, key=lambda x: (x[2] is not None, x[2] or DAY, x[1]))
        sent, waiting = ready[:budget], ready[budget:]
        for source, ok in ended.items():
            oldest = [a for s, _, a in waiting if s == source and a]
            cutoffs[source] = min([now, *oldest]) if ok else cutoffs.get(source, now - look_back)
        told.append((sorted(k for _, k, _ in sent), len(waiting), dict(cutoffs)))
    return told


def test_deferred_items_come_back_and_run_dry(stored, tmp_path):
    """24 items, 10 a run: 10, 10, 4, none; each once, though feeds give all of them each time."""
    feed = [("w", f"s{i % 3}", f"k{i:02d}", hour(i - 30) if i % 8 else None, True) for i in range(24)]
    fetched = lambda h, *bad: [("w", f"s{s}", None, hour(h), s not in bad) for s in range(3)]
    late = [("w", "s2", "late", hour(-24 * 40), True)]
    parts = [feed + fetched(1, 2), feed + fetched(2) + late, feed + fetched(3), feed + fetched(4, 0), [("w", "s0", "new", hour(4.5), True), *fetched(5)]]
    rows = collected(admission.admitted(batches(stored, tmp_path / "in", parts, admission.ARRIVALS), 10), "admitted", "update", tmp_path / "c")
    runs = {r["at"]: r for r in rows if r.kind == "run"}
    assert [(runs[t].sent, runs[t].waiting) for t in sorted(runs)] == [(10, 14), (10, 4), (4, 0), (0, 0), (1, 0)]
    items = [r.key for r in rows if r.kind == "item"]
    assert len(items) == len(set(items)) == 25 and "late" not in items
    told = model(parts, 10, dt.timedelta(days=30))
    assert [len(k) for k, _, _ in told] == [10, 10, 4, 0, 1]
    got = {}
    for r in rows:
        if r.kind == "cutoff":
            got.setdefault(r.source, []).append(r.cutoff)
    assert {s: [cutoffs[s] for _, _, cutoffs in told] for s in got} == got
    assert got["s2"][0] == hour(1) - dt.timedelta(days=30)  # failed at first: pinned to what it had to go by
    assert got["s0"][2:] == [hour(3), hour(3), hour(5)]  # failed in the fourth run


def test_watches_are_apart_and_state_outlives_the_stream(stored, tmp_path):
    first = [("a", "s", "x", hour(0), True), ("b", "s", "x", hour(0), True), ("a", None, "y", None, True), ("a", "s", None, hour(1), True), ("b", "s", None, hour(1), True)]
    rows = collected(admission.admitted(batches(stored, tmp_path / "in", [first], admission.ARRIVALS), 1), "first", "update", tmp_path / "c")
    assert sorted((r.watch, r.key) for r in rows if r.kind == "item") == [("a", "y"), ("b", "x")]
    again = [("a", "s", "x", hour(0), True), ("a", "s", None, hour(2), True)]
    stored.createDataFrame(again, admission.ARRIVALS).coalesce(1).write.parquet(f"{tmp_path}/in/001")
    stream = stored.readStream.schema(admission.ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    checkpointed = admission.admitted(stream, 1)
    out = []
    query = checkpointed.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(240)
    assert [(r.watch, r.key) for r in out if r.kind == "item"] == [("a", "x")]
    assert [(r.sent, r.waiting) for r in out if r.kind == "run"] == [(1, 0)]


def test_cadence_follows_the_batch_fold(stored, small, tmp_path):
    """Over several triggers the stream polls as one fold over all rows; silence fires a timer with the last good value."""
    events = stored.read.parquet(f"{small}/events.parquet").withColumn("read", F.when(F.col("event_type") != "error", F.col("value")))
    n = events.count()
    silent = events.agg(F.min("user_id")).first()[0]
    events = events.where((F.col("user_id") != silent) | (F.col("event_id") < n // 3))
    parts = []
    for i in range(3):
        mine = events.where((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3))
        parts.append([tuple(r) for r in mine.select("event_id", F.col("ts").cast("timestamp"), "user_id", "read").collect()])
    stream = batches(stored, tmp_path / "in", parts, "event_id long, ts timestamp, user_id long, read double")
    told = cadence.polled(stream, F.col("user_id"), F.col("ts"), F.col("event_id"), F.col("read"), 14_400, 2 * 86_400)
    rows = collected(told, "cadence", "append", tmp_path / "c")
    seconds = events.withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    batch = folds.polled(seconds, ["user_id"], "s", ["ts", "event_id"], "read", 14_400)
    assert {(r.unique, r.polled, r.good) for r in rows if not r.stale} == {(r.event_id, r.polled, r.good) for r in batch.select("event_id", "polled", "good").collect()}
    stale = [r for r in rows if r.stale]
    good = {}
    for r in sorted((r for r in rows if not r.stale), key=lambda r: (r["at"], r.unique)):
        good.setdefault(r.source, []).append((r["at"], r.good))
    assert str(silent) in {r.source for r in stale}
    for r in stale:  # nothing well polled in between, and the value is the last good one
        before = [g for at, g in good[r.source] if at <= r["at"]]
        assert r.good == before[-1]


def test_slow_readers_see_the_last_snapshot(spark, tmp_path):
    path = str(tmp_path / "table")
    parts = [[(d, n * 10 + k, f"{d}-{n}-{k}") for d in range(3) for k in range(4) if (d + n) % 2 or n == 0] for n in range(4)]
    stream = batches(spark, tmp_path / "in", parts, "device int, seq int, snapshot string")
    conflation.conflate(stream, "device", "seq", path, str(tmp_path / "c")).awaitTermination(240)
    number, rows = conflation.seen_by(spark, path)
    assert number == 4
    newest = {}
    for part in parts:
        for d, s, text in part:
            newest[d] = max(newest.get(d, (0, "")), (s, text))
    assert {r.device: (r.seq, r.snapshot) for r in rows.collect()} == newest
    slow = manifests.read(spark, path, 1)  # a reader that began with the first goes on reading it
    assert {r.device: r.seq for r in slow.collect()} == {0: 3, 1: 3, 2: 3}
    conflation.conflate(stream, "device", "seq", path, str(tmp_path / "c2")).awaitTermination(240)  # all batches again
    assert manifests.version(spark, path).number == 4


def test_progress_log_and_replay(spark, tmp_path):
    log = str(tmp_path / "log")
    listener = progress.ProgressLog(spark, log)
    spark.streams.addListener(listener)
    try:
        stream = batches(spark, tmp_path / "in", [[(i, j) for j in range(i + 1)] for i in range(3)], "a int, b int")
        counted = stream.observe("told", F.count("*").alias("n"), F.max("b").alias("most"))
        good = counted.writeStream.format("noop").queryName("good").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        good.awaitTermination(240)
        broken = stream.select(F.raise_error(F.lit("no such thing"))).writeStream.format("noop").queryName("bad").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "d")).start()
        with pytest.raises(Exception, match="no such thing"):
            broken.awaitTermination(240)
        for _ in range(100):
            if progress.replay(spark, log).where(F.col("event").isin(*progress.FINAL)).count() == 2:
                break
            import time

            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    entries = progress.replay(spark, log).orderBy("seq").collect()
    assert [e.seq for e in entries] == list(range(1, len(entries) + 1))
    own = [e for e in entries if e.run == str(good.runId)]
    assert [e.event for e in own][0] == "started" and own[-1].event == "finished"
    told = [json.loads(e.observed)["told"] for e in own if e.event == "progress" and e.rows]
    assert told == [{"n": 1, "most": 0}, {"n": 2, "most": 1}, {"n": 3, "most": 2}]
    later = progress.replay(spark, log, after=own[1].seq).collect()
    assert {e.seq for e in later} == {e.seq for e in entries if e.seq > own[1].seq}
    ends = {r.run: (r.last, r.ended) for r in progress.states(progress.replay(spark, log)).collect()}
    assert ends == {str(good.runId): ("finished", True), str(broken.runId): ("failed", True)}
    assert progress.ProgressLog(spark, log).append("x", None, "started") == len(entries) + 1  # goes on behind what is there


def test_states_ignore_what_follows_an_end(spark):
    rows = [("a", 1, "started"), ("a", 2, "finished"), ("a", 3, "progress"), ("b", 1, "started"), ("b", 5, "progress"), (None, 1, "x"), ("c", 9, "failed")]
    found = progress.states(spark.createDataFrame(rows, "run string, seq int, event string"))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 2, "finished", True, 2), ("b", 2, "progress", False, None), ("c", 1, "failed", True, 9)]


def test_state_is_asked_by_parts_not_by_items():
    """Of 50,000 items each part of the known keys is looked up and written once, and known ones don't come again."""
    from pyspark.sql.types import Row

    from sparkreef.streaming import admission

    asked = []

    class State:
        def __init__(self):
            self.held = {}

        def containsKey(self, key):  # noqa: N802
            asked.append(key)
            return key in self.held

        def getValue(self, key):  # noqa: N802
            asked.append(key)
            return self.held[key]

        def updateValue(self, key, value):  # noqa: N802
            asked.append(key)
            self.held[key] = value

        def exists(self):
            return "all" in self.held

        def get(self):
            return iter(self.held["all"])

        def put(self, rows):
            self.held["all"] = [tuple(r) for r in rows]

        def clear(self):
            self.held.clear()

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return State()

        getListState = getMapState  # noqa: N815

    processor = admission.Admission(10, 100)
    processor.init(Handle())
    item = lambda i: Row(watch="w", source="s", key=f"k{i}", at=10**9 + i, ok=True)
    end = Row(watch="w", source="s", key=None, at=10**9, ok=True)
    rows = list(processor.handleInputRows(("w",), iter([*map(item, range(50_000)), end]), None))
    assert [r.key for r in rows[:10]] == [f"k{i}" for i in range(10)] and rows[-1].waiting == 49_990
    assert len(asked) < 2 * admission.PARTS + 10
    again = list(processor.handleInputRows(("w",), iter([item(3), item(50_001), end]), None))
    assert [r.key for r in again[:10]] == [f"k{i}" for i in range(10, 20)] and again[-1].waiting == 49_981
