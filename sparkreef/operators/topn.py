"""Fair, capped and global selections. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` numbered from 1 in one order. For results of a limited size only: it takes one task."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def numbered(df: DataFrame, bucket: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """All of ``df`` numbered from 1 by ``bucket``, then ``order``; buckets must be small.

    Rows are numbered within their bucket; only the buckets' counts meet in one task.
    """
    names = [f"_b{i}" for i in range(len(bucket))]
    held = df.withColumns(dict(zip(names, bucket, strict=True)))
    before = F.sum("_n").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, -1))
    starts = held.groupBy(*names).agg(F.count("*").alias("_n")).select(*names, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = held.withColumn("_at", F.row_number().over(W.partitionBy(*names).orderBy(*order)))
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"placed.{c}").eqNullSafe(F.col(f"starts.{c}"))
    met = placed.alias("placed").join(starts.alias("starts"), same)
    return met.select(*(f"placed.`{c}`" for c in df.columns), (F.col("_before") + F.col("_at")).alias(name))


def numbered_within(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` numbered from 1 in each group by ``bucket``, then ``order``; a bucket of a group must be small.

    Rows are numbered within their bucket, and only the buckets' counts meet by group, so that a group
    with most of the rows is shared by many tasks. Nulls are a group.
    """
    held = df.withColumn("_bucket", bucket)
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = held.groupBy(*group, "_bucket").agg(F.count("*").alias("_n")).select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = held.withColumn("_at", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)))
    same = F.lit(True)
    for c in [*group, "_bucket"]:
        same = same & F.col(f"placed.`{c}`").eqNullSafe(F.col(f"starts.`{c}`"))
    met = placed.alias("placed").join(starts.alias("starts"), same)
    return met.select(*(f"placed.`{c}`" for c in df.columns), (F.col("_before") + F.col("_at")).alias(name))


def fair_top(df: DataFrame, n: int, source: str, at: str, unique: str) -> DataFrame:
    """``n`` rows, newest first within a source, sources in turns by their newest row; column pick.

    Tasks keep ``n`` rows of a source before the shuffle, so that a source with most of the rows costs no
    more than another; the last step gets ``n`` of each and keeps the ``n`` best. A null source is one
    like any other, and the last among equals.
    """
    newest = W.partitionBy(source).orderBy(F.desc_nulls_last(at), unique)
    turns = df.withColumn("_turn", F.row_number().over(newest)).where(F.col("_turn") <= n)
    turns = turns.withColumn("_head", F.max(at).over(W.partitionBy(source)))  # of rows that are few by now
    order = [F.col("_turn"), F.desc_nulls_last("_head"), F.asc_nulls_last(source)]
    best = turns.orderBy(*order).limit(n)
    return ranked(best, order, "pick").drop("_turn", "_head")


def top_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    numbered = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col(name) <= n)


def top(df: DataFrame, n: int, order: Sequence[Column], name: str = "rank") -> DataFrame:
    return ranked(df.orderBy(*order).limit(n), order, name)


def feed_window(df: DataFrame, since: Column, source: str, at: str, unique: str, most: int = 40, undated: int = 30) -> DataFrame:
    """Per source: rows since ``since``, newest first, ``most`` of them; undated ones only in the room
    that is left, ``undated`` at most, in order of ``unique``."""
    recent = df.where(F.col(at).isNull() | (F.col(at) >= since)).withColumn("_dated", F.col(at).isNotNull())
    order = W.partitionBy(source, "_dated").orderBy(F.desc_nulls_last(at), unique)
    numbered = recent.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    kept = F.count_if("_dated").over(W.partitionBy(source))
    room = F.least(F.lit(undated), F.lit(most) - kept)
    return numbered.withColumn("_room", room).where(F.col("_dated") | (F.col("_n") <= F.col("_room"))).drop("_dated", "_n", "_room")
