"""Per-source cutoffs: event-time watermarks that move only when a source succeeds.

State is a table (source, has_cutoff, cutoff): a source without a row, or whose row has no cutoff,
falls back to the common one; one whose cutoff is there and null has never succeeded and is not
filtered by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_cutoffs(items: DataFrame, state: DataFrame, common: Column, source: str = "source") -> DataFrame:
    """``items`` with the column cutoff."""
    known = state.select(source, F.col("has_cutoff").alias("_has"), F.col("cutoff").alias("_cutoff"))
    chosen = F.when(F.coalesce("_has", F.lit(False)), F.col("_cutoff")).otherwise(common)
    return items.join(known, source, "left").withColumn("cutoff", chosen).drop("_has", "_cutoff")


def since_cutoff(items: DataFrame, at: str) -> DataFrame:
    """Rows not before their cutoff; undated rows and rows without a cutoff stay."""
    return items.where(~F.coalesce(F.col(at) < F.col("cutoff"), F.lit(False)))


def null_poisoned_min(column: str) -> Column:
    """The least value, or null as soon as one is."""
    return F.when(F.count("*") == F.count(column), F.min(column))


def advanced(state: DataFrame, runs: DataFrame, deferred: DataFrame, common: Column, now: Column) -> DataFrame:
    """The state after a run.

    ``runs`` (source, ok) and ``deferred`` (source, at): a source that succeeded moves to ``now``,
    but no further than the oldest of its deferred rows; one that failed keeps what it has, and the
    first failure pins it to the old common cutoff.
    """
    held = deferred.groupBy("source").agg(F.min("at").alias("held"))
    old = state.select("source", F.col("has_cutoff").alias("_has"), F.col("cutoff").alias("_old"))
    joined = runs.join(old, "source", "left").join(held, "source", "left")
    kept = F.when(F.coalesce("_has", F.lit(False)), F.col("_old")).otherwise(common)
    moved = F.least(F.coalesce("held", now), now)
    return joined.select(
        "source", F.lit(True).alias("has_cutoff"), F.when(F.col("ok"), moved).otherwise(kept).alias("cutoff")
    )
