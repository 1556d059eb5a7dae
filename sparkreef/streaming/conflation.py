"""Snapshots of which only the newest counts: updates of a stream into a table that readers take whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkreef.sources import manifests


def newest(snapshots: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest ``seq`` of each key; on a stream, to be written in update mode."""
    rest = [c for c in snapshots.columns if c not in (key, seq)]
    return snapshots.groupBy(key).agg(F.max(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_row")).select(key, seq, *(f"_row.{c}" for c in rest))


def conflate(snapshots: DataFrame, key: str, seq: str, path: str, checkpoint: str, stream: str = "snapshots") -> StreamingQuery:
    """Starts a stream that keeps ``path`` at the newest snapshot of each key.

    Each batch becomes a version of the table, made of the last one and the keys that moved on; its
    manifest holds the batch's number, so that a batch that runs again after a crash changes nothing.
    However many batches go by, a reader that comes late reads one version: the last.
    """

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        last = manifests.version(spark, path)
        if last and last.entry.get(stream, -1) >= n:
            rows.write.format("noop").mode("overwrite").save()  # the state is committed by reading it all
            return
        merged = rows if not last else newest(spark.read.parquet(last.folder).unionByName(rows), key, seq)
        manifests.replace(merged, path, last.number if last else 0, **{stream: n})

    return newest(snapshots, key, seq).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def seen_by(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """What a reader finds now: the version's number and its rows, which stay these while it reads."""
    found = manifests.version(spark, path)
    if not found:
        raise FileNotFoundError(f"no version of {path} is published")
    return found.number, spark.read.parquet(found.folder)
