"""What to keep: newest per period, by count of periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_per_period(df: DataFrame, at: str, unique: str, period: Column) -> DataFrame:
    """One row per period: the newest, ties to the larger id. An aggregate, so periods are the only bound."""
    rest = F.struct(*df.columns)
    return df.groupBy(period.alias("_period")).agg(F.max_by(rest, F.struct(at, unique)).alias("_r")).select("_period", "_r.*")


def kept(df: DataFrame, at: str, unique: str, policies: Sequence[tuple[str, Column, Column, int]]) -> DataFrame:
    """(unique, policies) of the rows that any policy keeps: (name, period, eligible, n) keeps the
    newest row of each of the last n periods that have an eligible one."""
    found = None
    for name, period, eligible, n in policies:
        newest = newest_per_period(df.where(eligible), at, unique, period).orderBy(F.desc("_period")).limit(n)
        rows = newest.select(unique, F.lit(name).alias("policy"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy(unique).agg(F.array_join(F.array_sort(F.collect_set("policy")), ",").alias("policies"))


def last_used_first(df: DataFrame, used: str, added: str, unique: str, n: int) -> DataFrame:
    """The ``n`` rows longest unused; what was never used counts from when it was added."""
    order = [F.coalesce(F.col(used), F.col(added)), F.col(unique)]
    best = df.orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # n rows
