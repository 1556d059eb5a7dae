"""Quality rules with thresholds that follow each language and source, in DataFrame functions alone.

Every document gets whole-number measures. Their distribution per (language, source) is kept as a
quantile sketch: counts of documents by value, where values from EXACT on are known by their leading
bits, so that a quartile is at most 1/512 below the true one and no value is too large. A sketch has
some thousand entries per measure at most and two of them merge by adding counts. Quartiles of the
sketch set a fence for each measure; documents whose measures, as they are, lie beyond a fence are
dropped, by a join of the measures with the fences. A group of under ``least_group`` documents takes
the merged sketch of its language, and that of all documents if the language is small too.

A null or empty text has no words: all its counts are 0 and the base rules drop it. Null languages
and sources are groups of their own. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.llm.common import checkpointed

# Base rules.
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

#: Below this, sketches count each value; from it on, they know values by so many leading bits.
EXACT, LEADING_BITS = 1024, 10
#: The fence stands this many quartile ranges beyond the quartiles.
REACH = 3.0
#: (measure, least quartile range that counts, whether low values are fenced off too)
MEASURES = (("symbols", 20, False), ("dup_lines", 100, False), ("repeats", 60, False), ("word_length", 10, True))
LEAST_GROUP = 200

_BLANK = r"\x20\x09-\x0D"


def _count_repeated(sorted_runs: str) -> Column:
    """Words in the runs of ``sorted_runs`` (hash, place) whose hash another run shares."""
    s = F.col(sorted_runs)
    twice = F.filter(
        s, lambda x, i: (F.get(s, i - 1)["hash"] == x["hash"]) | F.coalesce(F.get(s, i + 1)["hash"] == x["hash"], F.lit(False))
    )
    return F.sort_array(F.transform(twice, lambda x: x["place"]))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col),
        *keep,
        F.regexp_extract_all(text, F.lit(f"[^{_BLANK}]+"), F.lit(0)).alias("_words"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_BLANK}]")).alias("_lines"),
    )
    counted = base.select(
        id_col,
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hashes"),
    )
    h = F.col("_hashes")
    runs = counted.withColumn(
        "_runs",
        F.when(
            F.size(h) >= 3,
            F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("_hashes")
    # Most texts repeat no run; only the others are sorted.
    some = F.size(F.array_distinct("_runs")) < F.size("_runs")
    pairs = F.sort_array(F.transform("_runs", lambda x, i: F.struct(x.alias("hash"), i.alias("place"))))
    ordered = runs.withColumn("_pairs", F.when(some, pairs)).drop("_runs")
    placed = ordered.withColumn("_places", _count_repeated("_pairs")).drop("_pairs")
    p = F.col("_places")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), F.lit(-3))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda n, x: n + x), F.lit(0)).cast("long")
    return placed.withColumn("n_repeat_words", repeated).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Whole numbers: shares in thousandths, mean word length in tenths."""

    def share(part: str, whole: str, scale: int) -> Column:
        return F.floor(scale * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")

    return {
        "symbols": share("n_symbols", "word_chars", 1000),
        "dup_lines": share("n_dup_lines", "n_lines", 1000),
        "repeats": share("n_repeat_words", "n_words", 1000),
        "word_length": share("word_chars", "n_words", 10),
    }


def step(value: Column) -> Column:
    """The least value that a sketch doesn't tell from this one."""
    grain = F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))).cast("long")
    return F.when(value < EXACT, value).otherwise(value - value % grain)


def sketch(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure, value, n): the sketches of each group."""
    values = F.array(*(F.struct(F.lit(name).alias("measure"), step(value).alias("value")) for name, value in measures().items()))
    return counts.select(*by, F.inline(values)).groupBy(*by, "measure", "value").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "value").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str], reach: float = REACH) -> DataFrame:
    """(by, size, fences): an array of (measure, low, high) for each group."""
    group = W.partitionBy(*by, "measure")
    upto = group.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sketches.withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(group))

    def quartile(q: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= q * F.col("size"), F.col("value")))

    quartiles = ranked.groupBy(*by, "measure").agg(
        F.max("size").alias("size"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    span, low = F.lit(None), F.lit(None)
    for name, least, both in MEASURES:
        wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * F.lit(reach)
        span = F.when(F.col("measure") == name, wide).otherwise(span)
        low = F.when((F.col("measure") == name) & F.lit(both), F.col("q1") - wide).otherwise(low)
    fence = F.struct("measure", low.cast("double").alias("low"), (F.col("q3") + span).cast("double").alias("high"))
    return quartiles.groupBy(*by).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(fence)).alias("fences"))


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    reach: float = REACH,
    least_group: int = LEAST_GROUP,
) -> DataFrame:
    """The counts of each row, with base_failed, kept and the measures that were beyond their fences."""
    named = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    counts = checkpointed(text_counts(named, "id", "text", ("lang", "source")).withColumn("base_failed", base_failed()))
    fine = sketch(counts.where(~F.col("base_failed")), ["lang", "source"])
    fine = checkpointed(fine)
    by_lang = merged(fine, ["lang"])
    own = fences(fine, ["lang", "source"], reach).alias("own")
    lang = fences(by_lang, ["lang"], reach).alias("lang")
    whole = fences(merged(by_lang, []), [], reach).alias("whole")
    chosen = (
        own.join(lang, F.col("own.lang").eqNullSafe(F.col("lang.lang")))
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            F.col("own.lang").alias("g_lang"),
            F.col("own.source").alias("g_source"),
            F.when(F.col("own.size") >= least_group, F.col("own.fences"))
            .when(F.col("lang.size") >= least_group, F.col("lang.fences"))
            .otherwise(F.col("whole.fences"))
            .alias("fences"),
        )
    )
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    value = F.lit(None)
    for name, column in measures().items():
        value_of = F.lit(name), column
        value = F.create_map(*value_of) if name == "symbols" else F.map_concat(value, F.create_map(*value_of))
    beyond = F.filter(
        "fences",
        lambda f: (F.col("values")[f["measure"]] > f["high"]) | F.coalesce(F.col("values")[f["measure"]] < f["low"], F.lit(False)),
    )
    judged = counts.join(chosen, same, "left").withColumn("values", value)
    judged = judged.withColumn("beyond", F.coalesce(F.transform(beyond, lambda f: f["measure"]), F.array().cast("array<string>")))
    return judged.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("beyond") == 0)).alias("kept"),
        "beyond",
    )
