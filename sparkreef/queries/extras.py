"""Smaller projections, padding, patterns by layer, parsed versions, contiguity, merged settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.functions import scalars
from sparkreef.queries import query, table


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size > 10""")
def p02_column_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name", "p_brand")


@query("""SELECT p_partkey, ((p_partkey + 255) // 256 * 256)::BIGINT AS padded, ((p_partkey + 6) // 7)::BIGINT AS parts FROM part""")
def x29_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.padded(key, 256).alias("padded"), F.ceil(key / 7).alias("parts"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(p_size), lambda i: CASE WHEN i % 6 = 5 THEN 'full' ELSE 'window' END), ',') AS layers FROM part""")
def x39_layer_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth layer sees the whole context, the others a window of it."""
    layers = F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.when(i % 6 == 5, "full").otherwise("window"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(layers, ",").alias("layers"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'build' ELSE 'semver' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE p_size END AS n0,
    CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 10 END AS n1 FROM part""")
def x41_parse_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    dotted = F.concat(F.lit("v"), F.concat_ws(".", "p_size", key % 10), F.lit("-stable"))
    written = F.when(key % 5 == 0, F.concat(F.lit("b"), key)).otherwise(dotted)
    parsed = table(spark, sf_dir, "part").select("p_partkey", scalars.version(written).alias("v"))
    return parsed.select("p_partkey", "v.kind", "v.n0", "v.n1")


@query("""WITH t AS (SELECT p_brand, p_partkey, sum(p_size) OVER w - p_size + CASE WHEN p_partkey % 50 = 9 THEN 1 ELSE 0 END AS place, p_size FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
    n AS (SELECT *, lag(place + p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS wanted FROM t) SELECT p_brand, p_partkey FROM n WHERE place <> coalesce(wanted, 0)""")
def v10_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors that don't begin where the one before ends."""
    order = W.partitionBy("p_brand").orderBy("p_partkey")
    moved = F.when(F.col("p_partkey") % 50 == 9, 1).otherwise(0)
    placed = table(spark, sf_dir, "part").withColumn("place", F.sum("p_size").over(order) - F.col("p_size") + moved)
    wanted = F.coalesce(F.lag(F.col("place") + F.col("p_size")).over(order), F.lit(0))
    return placed.withColumn("wanted", wanted).where("place <> wanted").select("p_brand", "p_partkey")


@query("""SELECT p_partkey, 'a=' || CASE WHEN p_size > 25 THEN p_name ELSE 'base' END || ',b=2,c=' || p_size AS config FROM part""")
def j27_merge_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment over base settings; the fragment's values win."""
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit("2"))
    fragment = F.create_map(F.lit("c"), F.col("p_size").cast("string"), F.lit("a"), F.when(F.col("p_size") > 25, F.col("p_name")))
    merged = F.map_zip_with(base, F.map_filter(fragment, lambda _, v: v.isNotNull()), lambda _, old, new: F.coalesce(new, old))
    parts = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, ",").alias("config"))
