"""Writers. Spark's commit protocol makes each write all or nothing; what is added here is order and identity.

Tables that are replaced as a whole are in ``manifests``, lines that servers pick up in ``targets``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _escaped(value: Column) -> Column:
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(value, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(rows: DataFrame, metric: str, labels: Sequence[str], value: str) -> DataFrame:
    """(line): samples in the text format that metric servers scrape; null labels are left out."""
    parts = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f'{c}="'), _escaped(F.col(c).cast("string")), F.lit('"'))) for c in labels
    ]
    told = F.concat(F.lit(metric + "{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("} "))
    return rows.select(F.concat(told, F.col(value).cast("string")).alias("line"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows, as often. One aggregate of each, no rows moved: counts
    and sums of two hashes of every row."""

    def sums(df: DataFrame):
        columns = [F.col(c) for c in sorted(df.columns)]
        hashes = [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]
        return df.agg(F.count("*"), *(F.sum(h.cast("decimal(38,0)")) for h in hashes)).first()

    return sorted(a.columns) == sorted(b.columns) and sums(a) == sums(b)


def generated_states(fresh: DataFrame, there: DataFrame, path: str, body: str) -> DataFrame:
    """(path, state) of generated files: absent where nothing lies, else ok or STALE."""
    lies = there.select(path, F.col(body).alias("_there"), F.lit(True).alias("_lies"))
    state = F.when(F.col("_lies").isNull(), "absent").when(F.col("_there").eqNullSafe(F.col(body)), "ok").otherwise("STALE")
    return fresh.join(lies, path, "left").select(path, state.alias("state"))


def dumped(rows: DataFrame, declared: Sequence[str], key: str) -> DataFrame:
    """(key, line): each entry as JSON, its fields in the declared order, absent ones left out."""
    return rows.select(key, F.to_json(F.struct(*declared)).alias("line"))


def directory_sizes(files: DataFrame, path: str, size: str) -> DataFrame:
    """(dir, size, files): what lies in each directory and below it."""
    parts = F.split(path, "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    spread = files.where(F.contains(path, F.lit("/"))).select(F.explode(dirs).alias("dir"), F.col(size).alias("_size"))
    return spread.groupBy("dir").agg(F.sum("_size").cast("long").alias("size"), F.count("*").alias("files"))


def write_run(rows: DataFrame, path: str, watch: str = "watch") -> None:
    """Run artifacts as JSON, one folder per watch."""
    rows.write.mode("append").partitionBy(watch).json(path)


def artifacts(rows: DataFrame, run: str, fields: Sequence[str], page: Column) -> DataFrame:
    """(run, kind, body): a JSON record and a Markdown page of each run, to be written by ``write_run``."""
    record = F.struct(F.lit("json").alias("kind"), F.to_json(F.struct(*fields)).alias("body"))
    shown = F.struct(F.lit("markdown").alias("kind"), page.alias("body"))
    return rows.select(run, F.inline(F.array(record, shown)))


def upserted(current: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): what is wanted replaces what is there, null removes, the rest stays."""
    new = wanted.select(key, F.col(value).alias("_new"), F.lit(True).alias("_told"))
    joined = current.join(new, key, "full_outer")
    chosen = F.when(F.col("_told"), F.col("_new")).otherwise(F.col(value))
    return joined.select(key, chosen.alias(value)).where(F.col(value).isNotNull())


def report(rows: DataFrame, group: str, order: Sequence[str], line: Column, title: Column) -> DataFrame:
    """(group, place, line): a Markdown list per group, a row a line, the title at place 0."""
    place = F.row_number().over(W.partitionBy(group).orderBy(*order))
    lines = rows.select(group, place.alias("place"), line.alias("line"))
    titles = rows.groupBy(group).agg(F.max(title).alias("line")).select(group, F.lit(0).alias("place"), "line")
    return titles.unionByName(lines)


def lock_lines(files: DataFrame, mode: str, digest: str, path: str) -> DataFrame:
    """(line): ``mode digest path`` of each file, as lock files have them."""
    return files.select(F.concat_ws(" ", mode, digest, path).alias("line"))


