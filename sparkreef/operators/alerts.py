"""Alert states over samples: holds, thresholds, staleness, roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.operators import timeseries


def holds(samples: DataFrame, labels: Sequence[str], at: str, unique: str, condition: Column, hold_s: int) -> DataFrame:
    """(labels, since, until, state) of each stretch in which the condition held: firing once it has
    lasted ``hold_s`` seconds, else pending. A null condition doesn't hold."""
    order = W.partitionBy(*labels).orderBy(at, unique)
    marked = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    starts = (F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))).cast("int")
    stretched = marked.withColumn("_stretch", F.sum(starts).over(order)).where("_on")
    spans = stretched.groupBy(*labels, "_stretch").agg(F.min(at).alias("since"), F.max(at).alias("until"))
    lasted = F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return spans.withColumn("state", F.when(lasted >= hold_s * 1_000_000, "firing").otherwise("pending")).drop("_stretch")


def threshold_hits(samples: DataFrame, labels: Sequence[str], at: str, n: int, within_s: int) -> DataFrame:
    """Samples at which ``n`` or more of their series lie within the seconds before; column hits."""
    return timeseries.windowed(samples, labels, at, within_s, hits=F.lit(1)).where(F.col("hits") >= n)


def stale(samples: DataFrame, labels: Sequence[str], at: str, now: Column, after_s: int) -> DataFrame:
    """(labels, last, stale): whether a series was last seen over ``after_s`` seconds before now."""
    last = samples.groupBy(*labels).agg(F.max(at).alias("last"))
    gap = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return last.withColumn("stale", gap > after_s * 1_000_000)


def rolled_up(rows: DataFrame, groups: Sequence[str], ladder: Sequence[tuple[str, Column]], default: str) -> DataFrame:
    """(groups, level, reasons): the gravest level that any row has, gravest first in ``ladder``, and
    all levels that occur, in that order."""
    found = [F.coalesce(F.bool_or(condition), F.lit(False)) for _, condition in ladder]
    names = [F.when(has, name) for (name, _), has in zip(ladder, found, strict=True)]
    return rows.groupBy(*groups).agg(
        F.coalesce(*names, F.lit(default)).alias("level"), F.array_join(F.array_compact(F.array(*names)), ",").alias("reasons")
    )
