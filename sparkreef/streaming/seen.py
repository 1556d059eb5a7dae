"""Keys that have been seen, in files with filters: a batch reads only the files that may know its keys.

Each batch's keys are a folder of their own. Beside it stands a Bloom filter as a table of 64-bit
words, some ten bits a key. New keys meet the filters by equality on word numbers; only folders in
which some key has all its bits are read, and there keys are compared as they are, so that a filter's
false positives cost reading and change nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.sources import manifests

PROBES = 5
BITS_A_KEY = 10

#: Batches that others were merged into have numbers from here on.
MERGED = 10**9


def _probes(keys: DataFrame, key: str, width) -> DataFrame:
    """A row for each bit of each key: word, bit. ``width`` is the filter's number of bits, a power of two."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    at = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.xxhash64(i, text).bitwiseAND(width - 1))
    spread = keys.withColumn("_at", F.explode(at))
    return spread.select(*keys.columns, F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, int(_at & 63))").alias("bit"))


def add(keys: DataFrame, key: str, path: str, batch: int, **more) -> None:
    """Makes the keys batch number ``batch``, with its filter; a batch that is added again is replaced.

    Rows go first, then the filter; the entry that makes them count comes last.
    """
    spark = keys.sparkSession
    keys.select(key).distinct().write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")
    written = spark.read.parquet(f"{path}/keys/batch={batch}")
    n = written.count()
    bits = max(64, 1 << max(n * BITS_A_KEY - 1, 1).bit_length())
    words = _probes(written, key, F.lit(bits)).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    words.write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")
    files, at = manifests.file_system(spark, path)
    files.mkdirs(at(f"{path}/batches"))
    manifests.create_once(spark, f"{path}/batches/{batch:010d}.json", json.dumps({"batch": batch, "bits": bits, "n": n, **more}))


def batches(spark: SparkSession, path: str, before: int | None = None) -> list[dict]:
    """The batches that count, without those from ``before`` on; small entries, one a batch.

    A batch that was merged into another counts in that one.
    """
    files, at = manifests.file_system(spark, path)
    if not files.exists(at(f"{path}/batches")):
        return []
    told = [json.loads(r.value) for r in spark.read.text(f"{path}/batches/*.json", wholetext=True).collect()]
    if before is not None:
        told = [e for e in told if e.get("upto", e["batch"]) < before]
    covered = {n for e in told for n in e.get("covers", ())}
    return sorted((e for e in told if e["batch"] not in covered), key=lambda e: e["batch"])


def merge(spark: SparkSession, key: str, path: str, before: int) -> int | None:
    """Makes one batch of all before ``before``, so that filters stay few; its number, None if there is nothing to merge.

    The merged batch counts from the moment its entry stands, and what it covers no more. Folders of
    batches that were covered already when this began go now. So ``before`` is a number that no run
    goes back behind, and no batch is added meanwhile.
    """
    known = batches(spark, path, before)
    if len(known) < 2:
        return None
    files, at = manifests.file_system(spark, path)
    counts = {e["batch"] for e in batches(spark, path)}
    for part in ("keys", "filters"):
        for status in files.listStatus(at(f"{path}/{part}")):
            if int(status.getPath().getName().split("=")[1]) not in counts:
                files.delete(status.getPath(), True)
    upto = max(e.get("upto", e["batch"]) for e in known)
    keys = spark.read.parquet(*(f"{path}/keys/batch={e['batch']}" for e in known)).select(key)
    add(keys, key, path, MERGED + upto, upto=upto, covers=[e["batch"] for e in known])
    return MERGED + upto


def candidates(items: DataFrame, key: str, path: str, before: int | None = None) -> list[int]:
    """The batches whose filters let some key of ``items`` through."""
    spark = items.sparkSession
    known = batches(spark, path, before)
    if not known:
        return []
    keys = items.select(F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("_key")).distinct()
    widths = sorted({e["bits"] for e in known})
    asked = _probes(keys.withColumn("bits", F.explode(F.array(*map(F.lit, widths)).cast("array<bigint>"))), "_key", F.col("bits"))
    asked = asked.groupBy("_key", "bits", "word").agg(F.expr("bit_or(bit)").alias("wanted"))
    words = asked.groupBy("_key", "bits").agg(F.count("*").alias("words"))
    filters = None
    for width in widths:
        places = [f"{path}/filters/batch={e['batch']}" for e in known if e["bits"] == width]
        one = spark.read.option("basePath", f"{path}/filters").parquet(*places)
        one = one.select(F.lit(width).cast("long").alias("bits"), "word", F.col("bits").alias("held"), F.col("batch").cast("long").alias("batch"))
        filters = one if filters is None else filters.unionByName(one)
    met = asked.join(filters, ["bits", "word"]).where(F.col("held").bitwiseAND(F.col("wanted")) == F.col("wanted"))
    through = met.groupBy("batch", "_key", "bits").agg(F.count("*").alias("met")).join(words, ["_key", "bits"]).where("met = words")
    return sorted(r.batch for r in through.select("batch").distinct().collect())


def unseen(items: DataFrame, key: str, path: str, before: int | None = None) -> DataFrame:
    """``items`` whose key no batch before has; a null key is one like any other."""
    spark = items.sparkSession
    found = candidates(items, key, path, before)
    if not found:
        return items
    known = spark.read.parquet(*(f"{path}/keys/batch={n}" for n in found)).select(F.col(key).alias("_seen")).distinct()
    return items.join(known, items[key].eqNullSafe(known["_seen"]), "left_anti")
