"""Samples over time: resampling, counters, histograms, vector matching.

A series is what its label columns say. Rates are raw: the reset-aware increase over the window
divided by its length, without extrapolation to the window's edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.operators import dedupe, lineage


def seconds(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp")) / 1e6


def increases(samples: DataFrame, labels: Sequence[str], at: str, value: str, unique: str) -> DataFrame:
    """``samples`` with the column step: the rise since the series' sample before; after a reset the
    value itself; 0 at its first sample."""
    before = F.lag(value).over(W.partitionBy(*labels).orderBy(at, unique))
    step = F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("step", step)


def windowed(samples: DataFrame, labels: Sequence[str], at: str, length_s: int, **summed: Column) -> DataFrame:
    """``samples`` with sums of columns over each sample's window, the ``length_s`` seconds up to it.

    Time is cut into blocks as long as the window, so that a window is the beginning of its own block and
    the end of the one before. Each sample also goes on to the next block, and two running sums, one from
    the block's beginning, one from its end, make up the window's: the work is in proportion to the
    samples however many lie in a window, nothing is subtracted, and a series is dealt out by its blocks.
    """
    length = length_s * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    block = F.floor((micros - F.pmod(micros, F.lit(length))) / length)
    copies = F.array(F.lit(0), F.lit(1))
    spread = samples.withColumns({f"_sum_{name}": column for name, column in summed.items()}).withColumn("_late", F.explode(F.when(micros.isNull(), F.array(F.lit(0))).otherwise(copies)))
    spread = spread.withColumns({"_block": block + F.col("_late"), "_until": micros + F.col("_late") * length})
    spread = lineage.dealt(spread, *labels, "_block")
    series = W.partitionBy(*labels, "_block")
    until = series.orderBy("_until").rangeBetween(W.unboundedPreceding, W.currentRow)
    since = series.orderBy(F.desc("_until")).rangeBetween(W.unboundedPreceding, W.currentRow)
    parts = {}
    for name in summed:
        parts[f"_own_{name}"] = F.sum(F.when(F.col("_late") == 0, F.col(f"_sum_{name}"))).over(until)
        parts[f"_before_{name}"] = F.sum(F.when(F.col("_late") == 1, F.col(f"_sum_{name}"))).over(since)
    met = spread.withColumns(parts).where("_late = 0")
    whole = {name: F.coalesce(F.col(f"_own_{name}") + F.col(f"_before_{name}"), f"_own_{name}", f"_before_{name}") for name in summed}
    return met.withColumns(whole).select(*samples.columns, *summed)


def rate_raw(samples: DataFrame, labels: Sequence[str], at: str, value: str, unique: str, length_s: int) -> DataFrame:
    stepped = increases(samples, labels, at, value, unique)
    return windowed(stepped, labels, at, length_s, increase=F.col("step")).withColumn("rate", F.col("increase") / length_s)


def changes(samples: DataFrame, labels: Sequence[str], at: str, value: str, unique: str, length_s: int) -> DataFrame:
    """``samples`` with how often the value changed over the window."""
    before = F.lag(value).over(W.partitionBy(*labels).orderBy(at, unique))
    marked = samples.withColumn("_changed", F.coalesce((F.col(value) != before).cast("int"), F.lit(0)))
    return windowed(marked, labels, at, length_s, changes=F.col("_changed")).drop("_changed")


def resampled(
    samples: DataFrame, labels: Sequence[str], at: str, value: str, unique: str, start: Column, end: Column, step_s: int, look_back_s: int
) -> DataFrame:
    """(labels, grid, value): on each step of the grid, the last sample of the look-back before it.

    A sample goes straight to the few steps it can answer, so no join is needed.
    """
    t, t0, t1 = F.unix_seconds(F.col(at).cast("timestamp")), F.unix_seconds(start), F.unix_seconds(end)
    first = F.greatest(F.lit(0), F.ceil((t - t0) / step_s))
    exact = F.unix_micros(F.col(at).cast("timestamp")) > (t0 + first * step_s) * 1_000_000
    first = F.when(exact, first + 1).otherwise(first)
    last = F.least(F.floor((t1 - t0) / step_s), F.ceil((t - t0 + look_back_s) / step_s))
    steps = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    spread = samples.withColumn("_step", F.explode(steps)).withColumn("_grid", t0 + F.col("_step") * step_s)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    answers = spread.where(
        (micros <= F.col("_grid") * 1_000_000) & (micros > (F.col("_grid") - look_back_s) * 1_000_000)
    )
    latest = F.max_by(value, F.struct(at, unique)).alias(value)
    return answers.groupBy(*labels, F.timestamp_seconds("_grid").alias("grid")).agg(latest)


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], le: str, count: str, phi: float) -> DataFrame:
    """(labels, quantile) of cumulative bucket counts; ``le`` is infinite for the last bucket.

    Linear within a bucket, from 0 for the first; a rank in the last bucket gives the highest
    finite bound.
    """
    order = W.partitionBy(*labels).orderBy(le)
    total = F.max(count).over(W.partitionBy(*labels))
    rows = buckets.withColumns(
        {
            "_low": F.coalesce(F.lag(le).over(order), F.lit(0.0)),
            "_before": F.coalesce(F.lag(count).over(order), F.lit(0)),
            "_rank": F.lit(phi) * total,
        }
    )
    inside = rows.where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col(count)))
    linear = F.col("_low") + (F.col(le) - F.col("_low")) * (F.col("_rank") - F.col("_before")) / (F.col(count) - F.col("_before"))
    value = F.when(F.col(le) == float("inf"), F.col("_low")).otherwise(linear)
    return inside.select(*labels, value.alias("quantile"))


def matched(left: DataFrame, right: DataFrame, labels: Sequence[str], value: Column) -> DataFrame:
    """One-to-one matching on all labels: (labels, value); unmatched series vanish, and so do ratios
    without a value. A null label is one that a series lacks, and matches the same. Columns are
    left.value and right.value."""
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}"))
    joined = left.alias("left").join(right.alias("right"), same)
    return joined.select(*(F.col(f"left.{c}").alias(c) for c in labels), value.alias("value")).where("value is not null")


def or_else(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The left series, and those of the right whose labels it lacks; null labels match each other."""
    return left.unionByName(dedupe.unseen(right, left, labels))


def nearest(points: DataFrame, samples: DataFrame, at: str, sample_at: str, unique: str, within_s: int, key: str) -> DataFrame:
    """For each point the sample nearest in time, ``within_s`` at most; ties go to the smaller id.

    Both sides meet in time buckets of that length, a sample in the three it can serve.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (within_s * 1_000_000))
    spread = samples.withColumn("_b", F.explode(F.array(*(bucket(sample_at) + i for i in (-1, 0, 1)))))
    apart = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(sample_at).cast("timestamp")))
    met = points.withColumn("_b", bucket(at)).join(spread, "_b").withColumn("_d", apart).where(F.col("_d") <= within_s * 1_000_000)
    own = [c for c in points.columns if c != key]
    kept = [c for c in samples.columns]
    best = F.min_by(F.struct(*own, *kept), F.struct("_d", unique))
    return met.groupBy(key).agg(best.alias("_r")).select(key, "_r.*")
