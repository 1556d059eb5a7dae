"""Range joins against comparing every component with every range."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkreef.functions import versions
from sparkreef.operators import intervals


def key(text):
    if text is None:
        return None
    text = re.sub(r"^v\.?", "", text, flags=re.I)
    if m := re.fullmatch(r"b(\d+)", text):
        return ("b", int(m[1]))
    m = re.fullmatch(r"(\d+(?:\.\d+)*)(?:-stable)?(?:[-.]?(alpha|beta|rc)\.?(\d*))?", text)
    if not m:
        return None
    numbers = [*map(int, m[1].split(".")), 0, 0, 0, 0][:4]
    return ("s", numbers, {"alpha": 1, "beta": 2, "rc": 3}.get(m[2], 9), int(m[3] or 0))


VERSIONS = ["1", "1.0", "1.0.0", "v1.2.3", "v.2.8.0", "1.83.10-stable", "1.104.0rc1", "1.104.0", "1.104.0-beta.2", "10", "9.9.9.9", "b8145", "b99", "V260", "2.0.0alpha"]


def test_keys_sort_as_versions(spark):
    rows = spark.createDataFrame([(v,) for v in [*VERSIONS, "garbage", "", None, "1.", "12345678901"]], "v string")
    keys = {r.v: r.k for r in rows.select("v", versions.version_key(F.col("v")).alias("k")).collect()}
    assert all(keys[v] is None for v in ("garbage", "", None, "1.", "12345678901"))
    for a, b in itertools.product(VERSIONS, VERSIONS):
        if key(a)[0] == key(b)[0]:
            assert (keys[a] < keys[b], keys[a] == keys[b]) == (key(a) < key(b), key(a) == key(b)), (a, b)


RANGES = {
    ">= 1.0, < 2.0": lambda v: v[0] == "s" and key("1.0") <= v < key("2.0"),
    "1.0.0 - v1.104.0": lambda v: v[0] == "s" and key("1.0") <= v <= key("1.104"),
    ">= 1.0 < 1.2, >=2.0 < 3.0": lambda v: v[0] == "s" and (key("1.0") <= v < key("1.2") or key("2.0") <= v < key("3.0")),
    "1.0.0, v1.2.3": lambda v: v in (key("1.0"), key("1.2.3")),
    "< 1.2.3 || >= 9 and != 10": lambda v: v[0] == "s" and (v < key("1.2.3") or v >= key("9") and v != key("10")),
    "> 1.104.0rc1": lambda v: v[0] == "s" and v > key("1.104.0rc1"),
    "<= 10 or = 1.0": lambda v: v[0] == "s" and v <= key("10"),
    ">= b100": lambda v: v[0] == "b" and v >= key("b100"),
    "= 1.2.3; 10": lambda v: v in (key("1.2.3"), key("10")),
    "> 5, < 3": lambda v: False,
    "1.2.3": lambda v: v == key("1.2.3"),
}
UNREADABLE = ["", " ", None, "all of them", ">= 1.0, < b5", ">= x", "||"]


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_range_join(spark, buckets):
    rng = random.Random(2)
    own = [(i, rng.choice(["p", "p", "p", "q", None]), rng.choice([*VERSIONS, "?", None, f"{rng.randint(0, 12)}.{rng.randint(0, 120)}"])) for i in range(400)]
    told = [(i, p, t) for i, (p, t) in enumerate(itertools.product(["p", "q", "r", None], [*RANGES, *UNREADABLE]))]
    components = spark.createDataFrame(own, "id int, product string, version string")
    advisories = spark.createDataFrame(told, "advisory int, product string, affects string")
    found = intervals.affected(components, advisories, "product", "version", "affects", buckets)
    rows = sorted((r.id, r.advisory) for r in found.select("id", "advisory").collect())
    wanted = sorted((i, a) for i, p, v in own for a, q, t in told if p is not None and p == q and t in RANGES and key(v) and RANGES[t](key(v)))
    assert rows == wanted
    assert {r.affects for r in intervals.unread(advisories, "affects").collect()} == set(UNREADABLE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    components = spark.createDataFrame([], "id int, product string, version string")
    advisories = spark.createDataFrame([(1, "p", "> 1")], "advisory int, product string, affects string")
    assert intervals.affected(components, advisories, "product", "version", "affects").collect() == []
    one = spark.createDataFrame([(1, "p", "2")], components.schema)
    assert intervals.affected(one, advisories.limit(0), "product", "version", "affects").collect() == []


def test_hot_key_is_parted(spark):
    """One product has all the rows; its buckets share them."""
    points = spark.range(20_000).select(F.lit("p").alias("product"), (F.col("id") / 10).alias("at"))
    cuts = intervals.borders(points, F.col("at"), 16)
    ranges = spark.createDataFrame([("p", 100.0, 110.0), ("p", None, 5.0), ("p", 1990.0, None)], "product string, lo double, hi double")
    inside = (F.col("lo").isNull() | (F.col("lo") <= F.col("at"))) & (F.col("hi").isNull() | (F.col("at") <= F.col("hi")))
    met = intervals.range_join(points, ranges, ["product"], F.col("at"), F.col("lo"), F.col("hi"), inside, cuts)
    assert len(cuts) == 15 and met.count() == 101 + 51 + 100


def test_versions_and_ranges_are_read_once_each(spark):
    """Rows that repeat a version or a range meet by it; none is left out."""
    components = spark.range(300).select(F.col("id"), F.lit("p").alias("product"), (F.col("id") % 3).cast("string").alias("version"))
    advisories = spark.range(40).select(F.col("id").alias("advisory"), F.lit("p").alias("product"), F.when(F.col("id") % 2 == 0, ">= 1").otherwise("< 1 || 0 - 1").alias("affects"))
    found = intervals.affected(components, advisories, "product", "version", "affects")
    assert found.count() == 20 * 200 + 20 * 200 and found.distinct().count() == 8000
    assert "RegExp" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "regexp" not in plan
