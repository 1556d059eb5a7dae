"""Bodies and targets as data sources, and keys that have been seen."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkreef.sources import bodies, feeds, targets
from sparkreef.streaming import digest, seen

FEED = "<rss><channel><item><title>{0}</title><link>http://x/{0}</link></item><item><title>b</title></item></channel></rss>"


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(bodies.Bodies)
    path = tmp_path / "feeds"
    path.mkdir()
    (path / "one.xml").write_text("﻿" + FEED.format("a"))
    (path / "two.xml").write_text("<rss><channel><item>")
    (path / "three.xml").write_bytes(b"\xff\xfe<rss>")
    (path / "empty.xml").write_text("")
    (path / "_hidden").write_text("x")
    return path


def test_folder_of_feeds(spark, folder):
    rows = spark.read.format("bodies").option("folder", str(folder)).load()
    assert rows.rdd.getNumPartitions() == 4
    read = {r.source: r for r in rows.collect()}
    assert [r.source for r in sorted(read.values(), key=lambda r: r.place)] == ["empty.xml", "one.xml", "three.xml", "two.xml"]
    assert read["three.xml"].error == "not UTF-8" and not read["three.xml"].ok and read["one.xml"].bytes == len(FEED.format("a")) + 3
    told = feeds.parsed_feeds(rows.select("source", "body"), "body").collect()
    parsed = {r.source: r for r in told}
    assert [i.title for i in parsed["one.xml"]["items"]] == ["a", "b"] and parsed["two.xml"].error == "malformed" and not parsed["empty.xml"].ok


def test_named_sources_and_errors(spark, folder):
    named = {"good": f"file://{folder}/one.xml", "gone": f"{folder}/none.xml", "large": f"{folder}/two.xml", "odd": "nosuch://store/x"}
    rows = spark.read.format("bodies").option("sources", json.dumps(named)).option("mostBytes", 100).load()
    (folder / "one.xml").write_text("short")
    (folder / "two.xml").write_text("y" * 101)
    read = {r.source: (r.place, r.ok, r.error, r.body) for r in rows.collect()}
    assert read["good"] == (0, True, None, "short") and read["gone"][:3] == (1, False, "no such file") and read["large"][2] == "over 100 bytes"
    assert read["odd"][1] is False and read["odd"][2]


def test_stream_reads_what_has_changed(spark, folder, tmp_path):
    def run():
        got = []
        stream = spark.readStream.format("bodies").option("folder", str(folder)).load()
        query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        query.awaitTermination(120)
        return {r.source: r.ok for r in got}

    assert run() == {"one.xml": True, "two.xml": True, "three.xml": False, "empty.xml": True}
    assert run() == {}
    (folder / "two.xml").write_text(FEED.format("c"))
    (folder / "four.xml").write_text(FEED.format("d"))
    assert run() == {"two.xml": True, "four.xml": True}


def test_targets_are_replaced_as_a_whole(spark, tmp_path):
    uri = str(tmp_path / "targets")
    line = F.concat(F.lit("up{n=\""), F.col("id"), F.lit("\"} 1")).alias("line")
    targets.put_up(spark.range(50).repartition(4).select(line), uri)
    lines = lambda: sorted(r.line for r in targets.read_targets(spark, uri).collect())
    first = lines()
    assert len(first) == 50
    failing = spark.range(50, numPartitions=4).select(F.when(F.col("id") == 49, F.raise_error(F.lit("bad row"))).otherwise(line).alias("line"))
    with pytest.raises(Exception, match="bad row"):
        targets.put_up(failing, uri)
    assert lines() == first
    assert len([f for f in os.listdir(uri) if f.endswith(".prom")]) == 4  # what the failed write left is gone
    slow = targets.read_targets(spark, uri)
    targets.put_up(spark.range(3).select(line), uri)
    assert len(lines()) == 3 and len(slow.collect()) in (3, 50)
    targets.put_up(spark.range(0).select(line), uri)
    assert lines() == []
    with pytest.raises(Exception, match="one string column"):
        spark.range(3).write.format("targets").mode("overwrite").option("path", uri).save()


def test_seen_keys_read_few_files_and_miss_none(spark, tmp_path):
    path = str(tmp_path / "seen")
    key = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("key-"), "id").alias("key"))
    for batch in range(8):
        seen.add(key(batch * 1000, batch * 1000 + 1000), "key", path, batch)
    seen.add(spark.createDataFrame([(None,), ("a",)], "key string"), "key", path, 8)
    seen.add(key(0, 0), "key", path, 9)
    asked = key(2990, 3005).unionByName(key(90_000, 90_005)).unionByName(spark.createDataFrame([(None,), ("b",)], "key string"))
    found = seen.candidates(asked, "key", path)
    assert {2, 3, 8} <= set(found) and len(found) < 8
    left = sorted(r.key for r in seen.unseen(asked, "key", path).collect())
    assert left == sorted(["b", *(f"key-{i}" for i in range(90_000, 90_005))])
    assert seen.unseen(asked, "key", path, before=3).count() == asked.count() - 10
    misses = sum(bool(seen.candidates(key(100_000 + i * 50, 100_050 + i * 50), "key", path, before=1)) for i in range(4))
    assert misses <= 4 and seen.unseen(key(100_000, 100_200), "key", path).count() == 200  # false positives change nothing


def test_digest_reads_only_candidates(spark, tmp_path, monkeypatch):
    """Batches with keys of their own read no keys of others."""
    schema, places = "doc_id long, key string", [str(tmp_path / x) for x in ("out", "state", "checkpoint")]
    asked = []
    plain = seen.candidates
    monkeypatch.setattr(seen, "candidates", lambda *a, **b: asked.append(plain(*a, **b)) or asked[-1])
    for i in range(4):
        rows = [(n, f"key-{i}-{n}") for n in range(300)] + [(1000, f"key-{max(i - 1, 0)}-7")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        digest.run_digest(stream, "key", "doc_id", *places).awaitTermination(120)
    assert asked[0] == [] and [i - 1 in a for i, a in enumerate(asked)][1:] == [True] * 3
    found = [r.key for r in spark.read.parquet(places[0]).collect()]
    assert len(found) == len(set(found)) == 1200


def test_merged_batches_answer_alike(spark, tmp_path):
    path = str(tmp_path / "seen")
    key = lambda lo, hi: spark.range(lo, hi).select(F.concat(F.lit("key-"), "id").alias("key"))
    for batch in range(6):
        seen.add(key(batch * 100, batch * 100 + 100), "key", path, batch)
    asked = key(350, 450).unionByName(key(900, 905))
    before = sorted(r.key for r in seen.unseen(asked, "key", path, before=5).collect())
    assert seen.merge(spark, "key", path, before=4) == seen.MERGED + 3
    assert [e["batch"] for e in seen.batches(spark, path)] == [4, 5, seen.MERGED + 3]
    assert sorted(r.key for r in seen.unseen(asked, "key", path, before=5).collect()) == before
    assert seen.merge(spark, "key", path, before=6) == seen.MERGED + 5
    assert [e["batch"] for e in seen.batches(spark, path)] == [seen.MERGED + 5]
    left = sorted(r.key for r in seen.unseen(asked, "key", path).collect())
    assert left == sorted(f"key-{i}" for i in range(900, 905))
    assert seen.merge(spark, "key", path, before=6) is None
    assert not os.path.exists(f"{path}/keys/batch=2") and os.path.exists(f"{path}/keys/batch={seen.MERGED + 5}")
