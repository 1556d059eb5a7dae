"""The digest as a stream: each trigger takes what has arrived, writes the new items, then the state.

Output goes before state, both under the batch's id, so that a batch that is run again after a crash
writes the same files again and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkreef.operators import dedupe
from sparkreef.streaming import seen


def run_digest(items: DataFrame, key: str, order: str, out: str, state: str, checkpoint: str, first: int = 0) -> StreamingQuery:
    """Starts a run over all that has arrived: the first item of each key that no run before has had.

    ``items`` is a streaming frame; ``out`` and ``state`` get a folder per batch. Batches are numbered
    from ``first``, for a run that starts anew, with a checkpoint of its own, beside a state that is there.
    The state is kept by ``seen``: a batch reads only the keys that its filters can't rule out.
    """
    spark = items.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        number = first + n
        fresh = dedupe.first_wins(rows, [key], [order])
        fresh = seen.unseen(fresh, key, state, before=number)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.add(spark.read.parquet(f"{out}/batch={number}"), key, state, number)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts per window; rows up to ``late`` behind the newest still count."""
    dated = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return dated.groupBy(by, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def bounded_dedupe(events: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """First-wins within a bounded state: keys are forgotten once they are ``late`` behind."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])
