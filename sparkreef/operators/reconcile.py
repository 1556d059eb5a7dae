"""Desired against actual state: classes of differences, references, duplicates, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.operators import lineage


def reconciled(desired: DataFrame, live: DataFrame, key: str, same: Column) -> DataFrame:
    """(key, class): ok, update, missing (not live) or unmanaged (not desired); duplicate where the
    live side has the key more than once. ``same`` compares desired.* with live.*."""
    counted = live.groupBy(key).agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in live.columns if c != key))
    joined = desired.withColumn("_here", F.lit(True)).alias("desired").join(counted.alias("live"), key, "full_outer")
    kind = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_here").isNull(), "unmanaged")
        .when(F.col("_n") > 1, "duplicate")
        .when(same, "ok")
        .otherwise("update")
    )
    return joined.select(key, kind.alias("class"))


def drift(locked: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, drift) for keys that are missing, differ or are extra; those that agree don't show."""
    joined = locked.select(key, F.col(digest).alias("_want")).join(actual.select(key, F.col(digest).alias("_have")), key, "full_outer")
    kind = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_want") != F.col("_have"), "differs")
    return joined.select(key, kind.alias("drift")).where("drift is not null")


def dangling(rows: DataFrame, references: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(column, value, n) of references to what isn't there; null refers to nothing.

    Keys of one type are compared as they are, others as texts; only what is lost becomes text. Both sides
    are dealt out to the same tasks, where counting keeps a number for each key.
    """
    found = None
    for column, target, key in references:
        same = rows.schema[column].dataType == target.schema[key].dataType
        value = lambda c, same=same: (F.col(c) if same else F.col(c).cast("string")).alias("value")
        used = lineage.dealt(rows.select(value(column)).where("value is not null"), "value").groupBy("value").agg(F.count("*").alias("n"))
        known = lineage.dealt(target.select(value(key)), "value")
        lost = used.join(known, "value", "left_anti").select(F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "n")
        found = lost if found is None else found.unionByName(lost)
    return found


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def complete_shards(parts: DataFrame, group: str, index: str, of: str | None = None) -> DataFrame:
    """(group, complete): the indices are 1 to n, once each, and all agree on n; without ``of`` n is the largest index.

    Which indices a group has is kept as bits, 64 to a row, not as a set of values.
    """
    held = lineage.dealt(parts.select(group, F.col(index).alias("_index"), F.col(of or index).alias("_of")), group)
    bit = F.expr("shiftleft(1L, cast(pmod(_index, 64) as int))")
    bits = held.groupBy(group, F.floor(F.col("_index") / 64).alias("_word")).agg(
        F.count("*").alias("_n"), F.bit_count(F.bit_or(bit)).alias("_distinct"), F.min("_index").alias("_least"), F.max("_index").alias("_most"),
        F.min("_of").alias("_of_least"), F.max("_of").alias("_of_most"),
    )
    n, of_most = F.sum("_n"), F.max("_of_most")
    agreed = F.min("_of_least") == of_most if of else F.lit(True)
    return bits.groupBy(group).agg(
        ((n == of_most) & (F.sum(F.coalesce("_distinct", F.lit(0))) == n) & (F.min("_least") == 1) & (F.max("_most") == of_most) & agreed).alias("complete")
    )


def resolved_alias(wanted: DataFrame, models: DataFrame, name: str, key: str, aliases: str) -> DataFrame:
    """(name, key): what each name stands for, an own key before an alias, then the smallest key."""
    own = models.select(F.col(key).alias(name), F.col(key).alias("_key"), F.lit(0).alias("_prio"))
    other = models.select(F.explode(aliases).alias(name), F.col(key).alias("_key"), F.lit(1).alias("_prio"))
    best = own.unionByName(other).groupBy(name).agg(F.min_by("_key", F.struct("_prio", "_key")).alias(key))
    return wanted.join(best, name, "left")


def next_in(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """``df`` with the next value of ``order`` within the group: who stands in for a row; null for the last."""
    return df.withColumn(name, F.lead(order).over(W.partitionBy(*group).orderBy(order)))


def line_diff(old: DataFrame, new: DataFrame, line: str) -> DataFrame:
    """(side, line): lines of ``old`` that ``new`` lacks (-) and the other way round (+), each as often as it is
    missing. One aggregate over both, no join: a line's counts meet, however often it stands there."""
    both = old.select(line, F.lit(1).alias("_n")).unionAll(new.select(line, F.lit(-1).alias("_n")))
    apart = both.groupBy(line).agg(F.sum("_n").cast("int").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "-").otherwise("+")
    return apart.select(side.alias("side"), line, F.explode(F.sequence(F.lit(1), F.abs("_n"))).alias("_i")).select("side", line)
