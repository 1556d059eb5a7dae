"""A digest run from feed files to artifacts and the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.functions import text
from sparkreef.operators import cutoff, dedupe, topn
from sparkreef.sources import feeds


def digest_run(
    spark: SparkSession, path: str, seen: DataFrame, state: DataFrame, common: Column, now: Column, budget: int = 150
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(picked items, seen keys, source state) after a run over the feeds at ``path``.

    What is over budget stays unseen and holds its source's cutoff back, so the next run has it.
    """
    read = feeds.read_feeds(spark, path).withColumn("source", F.regexp_extract("path", "([^/]+?)(?:\\.[a-z]+)?$", 1))
    items = feeds.feed_items(read, "source").withColumn("key", text.item_key(F.col("title"), F.col("link")))
    fresh = dedupe.unseen(dedupe.first_wins(items, ["key"], ["source", "place"]), seen, ["key"])
    dated = cutoff.since_cutoff(cutoff.with_cutoffs(fresh, state, common), "at").drop("cutoff")
    picked = topn.fair_top(dated, budget, "source", "at", "key")
    deferred = dedupe.unseen(dated, picked, ["key"]).where("at is not null").select("source", "at")
    runs = read.select("source", "ok")
    return picked, dedupe.insert_only(seen, picked.select("key"), ["key"]), cutoff.advanced(state, runs, deferred, common, now)
