"""Null, tie and ordering rules of the relational operators."""

import re
import time

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.functions import scalars
from sparkreef.operators import curation, cutoff, dedupe, folds, lineage, reconcile, rules, timeseries, topn, validate


def test_first_wins_by_order_not_by_arrival(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), (None, 5)], "k string, n int").repartition(4)
    assert {(r.k, r.n) for r in dedupe.first_wins(rows, ["k"], ["n"]).collect()} == {("a", 1), (None, 2)}


def test_an_empty_cutoff_is_not_a_missing_one(spark):
    items = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, at int")
    state = spark.createDataFrame([("a", True, 5), ("b", True, None)], "source string, has_cutoff boolean, cutoff int")
    dated = cutoff.with_cutoffs(items, state, F.lit(9))
    assert {r.source: r.cutoff for r in dated.collect()} == {"a": 5, "b": None, "c": 9}
    assert [r.source for r in cutoff.since_cutoff(dated, "at").collect()] == ["b"]


def test_fair_top_takes_turns(spark):
    rows = spark.createDataFrame([("a", 9, 1), ("a", 8, 2), ("b", 5, 3), ("c", None, 4)], "s string, at int, id int")
    assert [r.id for r in topn.fair_top(rows, 3, "s", "at", "id").orderBy("pick").collect()] == [1, 3, 4]


def test_null_sources_and_keys_are_kept(spark):
    rows = spark.createDataFrame([("a", 9, 1), (None, 8, 2), (None, 7, 3)], "s string, at int, id int")
    assert [r.id for r in topn.fair_top(rows, 3, "s", "at", "id").orderBy("pick").collect()] == [1, 2, 3]
    assert [r.id for r in dedupe.unseen(rows, rows.where("id = 2"), ["s"]).collect()] == [1]
    left = spark.createDataFrame([("x", None, 1.0)], "a string, b string, value double")
    right = spark.createDataFrame([("x", None, 2.0), ("y", None, 3.0)], "a string, b string, value double")
    assert sorted(r.value for r in timeseries.or_else(left, right, ["a", "b"]).collect()) == [1.0, 3.0]
    ratio = timeseries.matched(left, right, ["a", "b"], F.col("left.value") / F.col("right.value"))
    assert [tuple(r) for r in ratio.collect()] == [("x", None, 0.5)]


def test_numbers_go_on_over_buckets(spark):
    rows = spark.range(50).withColumn("k", F.when(F.col("id") % 7 != 0, F.col("id") % 7))
    found = topn.numbered(rows, [F.col("k")], [F.col("id")], "n").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 51))
    assert [r.id for r in found] == [r.id for r in sorted(found, key=lambda r: (r.k is not None, r.k or 0, r.id))]


def test_replies_that_overflow_are_halved(spark):
    """Three times at most; what is still too long says so, an invalid reply is asked for once more."""
    items = spark.createDataFrame([("b", i, s) for i, s in enumerate([9, 1, 1, 1, 50])], "batch string, i int, size int")

    def reply(parts):
        valid = F.when(F.min("i") == 1, F.max("attempt") == 2).otherwise(F.min("i") != 2)
        return parts.groupBy("batch", "part").agg((F.sum("size") > 9).alias("overflow"), valid.alias("valid"))

    found = {r.part: (r.n, r.attempts, r.outcome) for r in curation.in_halves(items, ["batch"], "i", reply).collect()}
    assert found == {"00": (1, 1, "ok"), "01": (1, 2, "ok"), "10": (1, 2, "invalid"), "110": (1, 1, "ok"), "111": (1, 1, "too long")}


def test_claims_take_what_is_free(spark):
    rows = spark.createDataFrame([(1, 1, "a", ["b", "c", "b"]), (1, 2, "b", ["d"]), (1, 3, "e", ["c", "f"]), (2, 1, "b", [])], "run int, o int, i string, also array<string>")
    found = curation.claimed(rows, "run", "o", "i", "also").collect()
    assert sorted((r.run, r.o, r.i, r.also) for r in found) == [(1, 1, "a", ["b", "c"]), (1, 3, "e", ["f"]), (2, 1, "b", [])]


def test_counters_start_anew(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 8.0), (3, 2.0), (4, 2.0)], "id int, v double").withColumn("s", F.lit(1)).withColumn("at", F.timestamp_seconds("id"))
    assert [r.step for r in timeseries.increases(rows, ["s"], "at", "v", "id").orderBy("id").collect()] == [0.0, 3.0, 2.0, 0.0]


def test_quantile_in_the_last_bucket_is_the_highest_bound(spark):
    rows = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (1, float("inf"), 9)], "s int, le double, n long")
    assert timeseries.histogram_quantile(rows, ["s"], "le", "n", 0.9).first().quantile == 20.0


def test_versions_compare_by_kind(spark):
    texts = {"1.83.10-stable": "semver", "1.104.0rc1": "semver", "v.2.8.0": "semver", "b8145": "build", "v260": "semver", "garbage": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.version(F.col("t")).alias("v"))
    assert {r.t: r.v and r.v.kind for r in rows.collect()} == texts
    order = lambda a, b: spark.range(1).select(scalars.compare_versions(scalars.version(F.lit(a)), scalars.version(F.lit(b))).alias("c")).first().c
    assert (order("1.104.0rc1", "1.104.0"), order("b1", "1.0"), order("1.9", "1.10")) == (-1, None, -1)


def test_unknown_versions_stay_unknown(spark):
    rows = spark.createDataFrame([("1.5",), ("3.0",), ("?",)], "t string")
    found = rows.select("t", scalars.in_range(scalars.version(F.col("t")), [[(">=", "1.0"), ("<", "2.0")]]).alias("hit"))
    assert {r.t: r.hit for r in found.collect()} == {"1.5": True, "3.0": False, "?": None}


def test_classes_of_a_reconciliation(spark):
    want = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x")], "k int, v string")
    live = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x"), (4, "x"), (5, "x")], "k int, v string")
    found = reconcile.reconciled(want, live, "k", F.col("desired.v") == F.col("live.v"))
    assert {r.k: r["class"] for r in found.collect()} == {1: "ok", 2: "update", 3: "missing", 4: "duplicate", 5: "unmanaged"}


def test_chunks_are_greedy(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "g int, o long, s long")
    assert [r.chunk for r in folds.chunked(rows, ["g"], "o", "s", 2, 12).orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_system_turns_are_merged(spark):
    turns = [(0, "system"), (1, "user"), (2, "system"), (3, "assistant"), (4, "system"), (5, "system"), (6, "user"), (7, "assistant"), (8, "system")]
    rows = spark.createDataFrame([(1, t, r, f"t{t}") for t, r in turns], "c long, turn long, role string, text string")
    out = folds.normalized_turns(rows, "c", "turn", "role", "text", ("<", ">")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text) for r in out] == [
        (0, "system", "t0"), (1, "user", "t1\n\n<t2>"), (3, "assistant", "t3"), (6, "user", "<t4\n\nt5>\n\nt6"), (7, "assistant", "t7"), (8, "user", "<t8>"),
    ]


def test_policies_take_the_first_rule_and_quote_the_rest(spark):
    rows = spark.createDataFrame([("a.b",), ("axb",), ("z",)], "t string")
    found = rows.select("t", rules.first_rule(F.col("t"), (("a.b", "one"), ("a?b", "two")), "none").alias("r"))
    assert {r.t: r.r for r in found.collect()} == {"a.b": "one", "axb": "two", "z": "none"}


def test_all_problems_of_a_row(spark):
    rows = spark.createDataFrame([(None, "x"), (5, "a")], "n int, s string")
    found = validate.violations(rows, validate.compiled({"n": {"required": True, "minimum": 3}, "s": {"enum": ["a"]}}))
    assert sorted(map(len, (r.problems for r in found.collect()))) == [0, 3]


def test_windows_are_summed_whatever_lies_in_them(spark):
    # 40,000 samples in one window: in proportion to pairs this takes minutes
    rows = spark.range(40_000).select(F.lit("a").alias("k"), F.timestamp_micros(F.col("id") * 1000 - 5_000_000).alias("at"), F.col("id"))
    began = time.monotonic()
    found = {r.id: r.held for r in timeseries.windowed(rows, ["k"], "at", 7, held=F.lit(1)).collect()}
    assert found == {i: min(i + 1, 7001) for i in range(40_000)}
    plan = timeseries.windowed(rows, ["k"], "at", 7, held=F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "specifiedwindowframe(RangeFrame, -7000000" not in plan
    assert time.monotonic() - began < 60


def test_windows_with_ties_nulls_and_edges(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 10, None), ("a", 10, 4), ("a", 11, 8), ("a", 25, None), ("b", None, 16), ("b", None, 32), (None, 3, 64), (None, -4, 128)]
    given = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, s long, v long, i int").withColumn("at", F.timestamp_seconds("s"))
    frame = W.partitionBy("k").orderBy("s").rangeBetween(-10, 0)
    wanted = {r.i: r.v for r in given.select("i", F.sum("v").over(frame).alias("v")).collect()}
    assert {r.i: r.x for r in timeseries.windowed(given, ["k"], "at", 10, x=F.col("v")).collect()} == wanted


def tasks_of(df):
    """The given numbers of tasks of a plan's shuffles."""
    return [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())]


def test_references_are_counted_in_many_tasks_by_their_own_type(spark):
    rows = spark.createDataFrame([(1, "01"), (1, "2"), (2, None), (None, "9"), (7, "2")], "a long, b string")
    ids = spark.createDataFrame([(1,), (1,), (None,), (9,)], "id long")
    found = reconcile.dangling(rows, [("a", ids, "id"), ("b", ids, "id")])
    assert {tuple(r) for r in found.collect()} == {("a", "2", 1), ("a", "7", 1), ("b", "01", 1), ("b", "2", 2)}
    assert tasks_of(found) and min(tasks_of(found)) >= lineage.TASKS
    assert "cast(a" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shards_are_complete_by_bits(spark):
    given = {"a": ([1, 2, 3], 3), "b": ([1, 2, 2], 3), "c": ([1, 3, 3], 3), "d": (range(1, 201), 200), "e": ([*range(1, 200), 64], 200), "f": ([2, 3], 3), "g": ([1, None], 2), "h": ([0, 1], 1), "i": ([1, 2], 1)}
    rows = spark.createDataFrame([(k, i, of) for k, (many, of) in given.items() for i in many], "k string, i int, n int")
    complete = lambda *of: {r.k for r in reconcile.complete_shards(rows, "k", "i", *of).where("complete").collect()}
    assert complete("n") == {"a", "d"} and complete() == {"a", "d", "i"}
    assert min(tasks_of(reconcile.complete_shards(rows, "k", "i", "n"))) >= lineage.TASKS
    plan = reconcile.complete_shards(rows, "k", "i")._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "Window" not in plan
