"""Curation of items in batches: replies that overflow, constraints on replies, claims across batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.operators.lineage import checkpointed


def enum_text(values: Column, shown: int = 6) -> Column:
    """``['a', 'b', …]``: the first values of an array, quoted, and whether there are more."""
    quoted = F.array_join(F.transform(F.slice(values, 1, shown), lambda v: F.concat(F.lit("'"), v.cast("string"), F.lit("'"))), ", ")
    return F.concat(F.lit("["), quoted, F.when(F.size(values) > shown, F.lit(", …")).otherwise(F.lit("")), F.lit("]"))


def in_halves(items: DataFrame, batch: Sequence[str], order: str, reply: Callable[[DataFrame], DataFrame], most_depth: int = 3) -> DataFrame:
    """(batch, part, n, attempts, outcome) of each part that batches end in.

    ``reply`` answers parts: of rows (batch, part, attempt, the items' columns) it makes a row per
    part with the columns overflow and valid. An overflowing part of several items is halved, the
    first half the smaller one, up to ``most_depth`` times; an invalid reply is repaired once. part
    names the halves taken, 0 or 1 each. Levels follow each other, parts of a level are one job's
    rows; what a level leaves is written to the checkpoint folder, so that plans don't grow.
    """
    keys = [*batch, "part"]
    left = items.withColumns({"part": F.lit(""), "attempt": F.lit(1)})
    done = None
    for depth in range(most_depth + 1):
        sizes = left.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
        said = reply(left).select(*keys, "overflow", "valid")
        doubtful = said.where("not overflow and not valid").select(*keys)
        again = reply(left.join(doubtful, keys, "left_semi").withColumn("attempt", F.lit(2)))
        again = again.select(*keys, F.col("overflow").alias("overflow2"), F.col("valid").alias("valid2"))
        told = sizes.join(said, keys).join(again, keys, "left")
        over = F.col("overflow") | F.coalesce("overflow2", F.lit(False))
        split = over & (F.col("n") > 1) & F.lit(depth < most_depth)
        outcome = F.when(over, "too long").when(F.col("valid") | F.coalesce("valid2", F.lit(False)), "ok").otherwise("invalid")
        attempts = F.when(F.col("valid2").isNull(), 1).otherwise(2)
        told = checkpointed(told.withColumns({"split": split, "attempts": attempts, "outcome": outcome}))
        ended = told.where("not split").select(*keys, "n", "attempts", "outcome")
        done = ended if done is None else done.unionByName(ended)
        if depth < most_depth:
            place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
            going = left.join(told.where("split").select(*keys, "n"), keys).withColumn("_place", place)
            half = F.when(F.col("_place") < F.floor(F.col("n") / 2), "0").otherwise("1")
            left = checkpointed(going.withColumn("part", F.concat("part", half)).drop("n", "_place"))
    return done


def claimed(runs: DataFrame, run: str, order: str, item: str, also: str) -> DataFrame:
    """(run, order, item, also): the entries of a run that count, with what each takes along.

    In order, an entry whose item was taken before is left out; else it takes its item and those of
    its ``also`` that are free, each once. A run is what one admission lets in, so it is small.
    """
    kind = runs.schema[item].dataType.simpleString()
    entries = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(also).alias("a"))))
    entry = f"struct<o:{runs.schema[order].dataType.simpleString()},i:{kind},a:array<{kind}>>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        used = F.array_append(state["used"], x["i"])
        free = F.array_except(x["a"], used)
        took = F.struct(
            F.concat(used, free).alias("used"),
            F.array_append(state["out"], F.struct(x["o"].alias("o"), x["i"].alias("i"), free.alias("a"))).alias("out"),
        )
        return F.when(F.array_contains(state["used"], x["i"]), state).otherwise(took)

    told = runs.groupBy(run).agg(F.aggregate(entries, start, step, lambda s: s["out"]).alias("_out"))
    return told.select(run, F.inline("_out")).toDF(run, order, item, also)


def reply_constraints(batches: DataFrame, ids: str, tiers: int, most_also: int, texts: dict[str, int]) -> DataFrame:
    """``batches`` with path, rule and bound: what a reply over the live ``ids`` (an array) must keep to."""
    live = F.col(ids)
    ids_text, n = enum_text(live), F.size(live).cast("string")
    levels = enum_text(F.array(*map(F.lit, range(1, tiers + 1))))
    rules = [
        ("$.tiers", "maxItems", F.lit(str(tiers))), ("$.tiers[].tier", "enum", levels), ("$.tiers[].items", "maxItems", n),
        ("$.tiers[].items[].id", "enum", ids_text), ("$.tiers[].items[].also", "maxItems", F.lit(str(most_also))),
        ("$.tiers[].items[].also[]", "enum", ids_text), ("$.tiers[].items[].confidence", "enum", enum_text(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))))),
        *((f"$.tiers[].items[].{name}", "maxLength", F.lit(str(most))) for name, most in texts.items()),
    ]
    told = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), b.alias("bound")) for p, r, b in rules))
    return batches.select(*(c for c in batches.columns if c != ids), F.inline(told))


def flag_problems(tokens: Column, alone: Sequence[str], valued: dict[str, tuple[str, str]]) -> Column:
    """The problems of a token list, in order: flags ``alone`` stand by themselves, ``valued`` ones
    (flag: (pattern, description)) take the next token, whatever it is."""
    known = [*alone, *valued]
    start = F.struct(F.lit(None).cast("string").alias("flag"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("told"))

    def chosen(flag: Column, part: int) -> Column:
        found = F.lit("")
        for name, rule in valued.items():
            found = F.when(flag == name, F.lit(rule[part])).otherwise(found)
        return found

    def step(s: Column, t: Column) -> Column:
        wrong = F.array(F.concat(s["flag"], F.lit(" "), t, F.lit(": value must be "), chosen(s["flag"], 1)))
        value = F.struct(F.lit(None).cast("string").alias("flag"), s["seen"].alias("seen"), F.when(F.regexp(t, chosen(s["flag"], 0)), s["told"]).otherwise(F.concat(s["told"], wrong)).alias("told"))
        strange = F.struct(s["flag"].alias("flag"), s["seen"].alias("seen"), F.array_append(s["told"], F.concat(t, F.lit(" is not whitelisted"))).alias("told"))
        twice = F.when(F.array_contains(s["seen"], t), F.array_append(s["told"], F.concat(t, F.lit(" given twice")))).otherwise(s["told"])
        flag = F.struct(F.when(t.isin(*valued), t).alias("flag"), F.array_append(s["seen"], t).alias("seen"), twice.alias("told"))
        return F.when(s["flag"].isNotNull(), value).when(t.isin(*known), flag).otherwise(strange)

    def finish(s: Column) -> Column:
        return F.when(s["flag"].isNotNull(), F.array_append(s["told"], F.concat(s["flag"], F.lit(" needs a value")))).otherwise(s["told"])

    return F.aggregate(tokens, start, step, finish)
