"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreef.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the component's smallest node.

    Each round points every node at the neighbour, or itself, whose hash is least, follows the
    pointer of that one too, and contracts the links accordingly, until none is left. Hashes stand
    in no order along a path and are the same in every round, so that chains shrink by a constant
    factor and stars fall together at once: the rounds grow with the logarithm of the longest chain.
    Nothing is collected: a round's minima are partial aggregates, and both tables are written to
    the checkpoint folder, so that the lineage stays short and a lost executor costs one round at
    most. Null ends and loops count for nothing; repeated and mirrored links count once.
    """
    links = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = checkpointed(links.where(F.col("a") < F.col("b")).distinct())
    roots = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    roots = checkpointed(roots.select("node", F.col("node").alias("root")))
    while not links.isEmpty():
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(
            links.select(F.col("b").alias("x"), F.col("a").alias("y"))
        )
        hashed = both.withColumn("h", F.xxhash64("y")).groupBy("x").agg(F.min_by("y", "h").alias("y"), F.min("h").alias("h"))
        own = F.xxhash64("x")
        lower = (F.col("h") < own) | ((F.col("h") == own) & (F.col("y") < F.col("x")))
        near = hashed.select("x", F.when(lower, F.col("y")).otherwise(F.col("x")).alias("to"))
        up = near.select(F.col("x").alias("to"), F.col("to").alias("on"))
        steps = checkpointed(near.join(up, "to").select("x", F.col("on").alias("to")))
        roots = checkpointed(
            roots.join(steps.withColumnRenamed("x", "root"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        )
        a = steps.select(F.col("x").alias("a"), F.col("to").alias("ra"))
        b = steps.select(F.col("x").alias("b"), F.col("to").alias("rb"))
        moved = links.join(a, "a").join(b, "b").where("ra <> rb")
        links = checkpointed(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))
