"""Where models go: one device, both, or both with the movable parts of some layers left to the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed(layers: DataFrame, model: str, layer: str, device: str, size: str, movable: str, limits: Sequence[int], budget: int) -> DataFrame:
    """(model, placement, moved, host): one, both, offload or none, and what the host takes.

    ``layers`` has a row per layer: its size, the part of it that is movable, and the device that has
    it where a model is spread over both, 0 or 1. A model goes to one device, the first, if all of it
    fits; to both if each has room for its layers. Else movable parts leave, one at a time, from the
    device that is most over its limit (the first of two that are alike), its lowest layer first,
    until both have room. The host takes ``budget`` at most; where that or what can be moved doesn't
    do, the placement is none.

    A device's overload falls with what it loses and with nothing else, so that each device's moves
    are a prefix of its layers, found by running sums, and the order of all moves is that of the
    overloads before them.
    """
    limit = F.when(F.col(device) == 0, limits[0]).otherwise(limits[1])
    own = W.partitionBy(model, device)
    before = F.coalesce(F.sum(movable).over(own.orderBy(layer).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = layers.withColumn("_load", F.sum(size).over(own)).withColumn("_over", F.col("_load") - limit - before)
    rows = rows.withColumn("_left", F.col("_load") - limit - F.sum(movable).over(own))
    step = F.struct((-F.col("_over")).alias("o"), F.col(device).alias("d"), F.col(layer).alias("l"))
    told = rows.groupBy(model).agg(
        F.sum(size).alias("_total"),
        F.max(F.col("_load") - limit).alias("_worst"),
        F.max("_left").alias("_stuck"),
        F.array_sort(F.collect_list(F.when(F.col("_over") > 0, step))).alias("_steps"),
        F.coalesce(F.sum(F.when(F.col("_over") > 0, F.col(movable))), F.lit(0)).alias("_host"),
    )
    placement = (
        F.when(F.col("_total") <= limits[0], "one").when(F.col("_worst") <= 0, "both").when((F.col("_stuck") <= 0) & (F.col("_host") <= budget), "offload").otherwise("none")
    )
    offload = F.col("placement") == "offload"
    return told.withColumn("placement", placement).select(
        model, "placement", F.when(offload, F.transform("_steps", lambda s: s["l"])).alias("moved"), F.when(offload, F.col("_host")).alias("host")
    )
