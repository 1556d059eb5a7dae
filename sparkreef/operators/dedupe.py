"""First-wins dedupe, priority union, state merge. Order is always given, never taken from arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``, which must end in something unique.

    An aggregate, not a window: a hot key is combined before the shuffle. Null keys are keys.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of all frames, one per key: of the frame that comes first, then by ``order``."""
    ranked = [df.withColumn("prio", F.lit(i)) for i, df in enumerate(frames)]
    union = ranked[0]
    for df in ranked[1:]:
        union = union.unionByName(df)
    return first_wins(union, keys, ["prio", *order])


def unseen(items: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items whose key the state doesn't have. Null is a key like any other: seen once, it is known."""
    known = seen.select(*(F.col(c).alias(f"_seen{i}") for i, c in enumerate(keys)))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & items[c].eqNullSafe(known[f"_seen{i}"])
    return items.join(known, same, "left_anti")


def insert_only(state: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state and the rows whose key it lacks; what is there stays as it is."""
    return state.unionByName(unseen(rows, state, keys))
