"""Placements against moving one layer at a time; curators; numbering and selection of hot groups."""

import random

from pyspark.sql import functions as F

from sparkreef.functions import scalars
from sparkreef.operators import placement, topn
from sparkreef.plans import curators
from sparkreef.sources import manifests


def moved(layers, limits, budget):
    """(placement, moved layers in order, host) by moving one at a time."""
    if sum(s for _, _, s, _ in layers) <= limits[0]:
        return "one", None, None
    load = [sum(s for _, d, s, _ in layers if d == g) for g in (0, 1)]
    if all(load[g] <= limits[g] for g in (0, 1)):
        return "both", None, None
    left = {g: sorted((x for x in layers if x[1] == g)) for g in (0, 1)}
    order, host = [], 0
    while any(load[g] > limits[g] for g in (0, 1)):
        g = max((0, 1), key=lambda g: (load[g] - limits[g], -g))
        if not left[g]:
            return "none", None, None
        layer, _, _, part = left[g].pop(0)
        load[g] -= part
        host += part
        order.append(layer)
        if host > budget:
            return "none", None, None
    return "offload", order, host


def test_placements(spark):
    rng = random.Random(6)
    models = {}
    for m in range(300):
        n = rng.randint(1, 12)
        models[m] = [(i, int(i >= n / 2), s := rng.randint(1, 40), rng.randint(0, s)) for i in range(n)]
    limits, budget = (90, 110), 70
    rows = [(m, *x) for m, layers in models.items() for x in layers]
    frame = spark.createDataFrame(rows, "model int, layer int, device int, size long, movable long").repartition(3)
    found = {r.model: (r.placement, r.moved, r.host) for r in placement.placed(frame, "model", "layer", "device", "size", "movable", limits, budget).collect()}
    wanted = {m: moved(layers, limits, budget) for m, layers in models.items()}
    assert found == wanted and {w[0] for w in wanted.values()} == {"one", "both", "offload", "none"}


def test_curators(spark):
    items = spark.createDataFrame([(i, i // 5, f"t{i}") for i in range(23)] + [(100, None, "x")], "id int, batch int, title string")

    def curate(rows):
        assert [r["id"] for r in rows] == sorted(r["id"] for r in rows) and len({r["batch"] for r in rows}) == 1
        if rows[0]["batch"] == 2:
            raise RuntimeError("overflow")
        if rows[0]["batch"] == 3:
            return [(r["id"], 1) for r in rows]  # a value too few
        return [(r["id"], r["title"].upper(), len(rows)) for r in rows if r["id"] % 2 == 0] + [(rows[0]["id"], "again", 0), (999, "no such", 0)]

    found = {r.id: tuple(r)[1:] for r in curators.curated(items, ["batch"], ["id"], "id", curate, "tier string, n int").collect()}
    assert len(found) == 24
    for i in range(23):
        problem = {2: "RuntimeError: overflow", 3: "ValueError: 1 values for 2 columns"}.get(i // 5)
        n = 3 if i // 5 == 4 else 5
        if problem:
            assert found[i] == (None, None, False, problem)
        elif i % 2 == 0:
            assert found[i] == (f"T{i}", n, True, None)
        elif i % 5 == 0:
            assert found[i] == ("again", 0, True, None)
        else:
            assert found[i] == (None, None, False, None)
    assert found[100] == ("X", 1, True, None)


def test_fair_top_keeps_few_rows_of_a_hot_source_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 70)).alias("source"), F.timestamp_seconds("id").alias("at"), "id")
    picked = topn.fair_top(rows, 12, "source", "at", "id")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    found = [(r.source, r.id) for r in picked.orderBy("pick").collect()]
    assert len(found) == 12 and [s for s, _ in found].count("hot") == 2
    assert found[:2] == [("s29", 4999), ("hot", 4998)]


def test_numbered_within_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "b", None]), i) for i in rng.sample(range(5000), 400)]
    frame = spark.createDataFrame(rows, "source string, id int").repartition(3)
    found = sorted(tuple(r) for r in topn.numbered_within(frame, ["source"], F.floor(F.col("id") / 100), [F.col("id")], "n").select("id", "source", "n").collect())
    order = {}
    wanted = []
    for source, i in sorted(rows, key=lambda x: x[1]):
        order[source] = order.get(source, 0) + 1
        wanted.append((i, source, order[source]))
    assert found == wanted


def test_expected_widths(spark):
    wide = lambda spec: [r.w for r in spark.range(4).select(scalars.expected_width(spec, F.col("id"), 16).alias("w")).collect()]
    assert wide("8") == [8] * 4 and wide("0=16,1=8") == [16, 8, 16, 16] and wide("") == wide("x,=1,2=,a=b") == [16] * 4
    assert wide("3=4, 3=2") == [16, 16, 16, 2]


def test_check_or_write(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, body string")
    states = lambda df: {r.path: r.state for r in df.collect()}
    assert states(manifests.check_or_write(frame(("a", "1")), path, "path", "body", False)) == {"a": "absent"}
    assert states(manifests.check_or_write(frame(("a", "1"), ("b", None)), path, "path", "body", True)) == {"a": "written", "b": "written"}
    fresh = frame(("a", "2"), ("b", None))
    assert states(manifests.check_or_write(fresh, path, "path", "body", False)) == {"a": "STALE", "b": "ok"}
    assert states(manifests.check_or_write(fresh, path, "path", "body", True)) == {"a": "written", "b": "ok"}
    assert states(manifests.check_or_write(frame(("a", "2")), path, "path", "body", True)) == {"a": "ok"}
    assert manifests.version(spark, path).number == 2 and sorted(map(tuple, manifests.read(spark, path).collect())) == [("a", "2"), ("b", None)]
