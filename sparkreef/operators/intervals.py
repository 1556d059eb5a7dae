"""Joins of points with intervals, by buckets: an equality for Spark to shuffle by, and no nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreef.functions import versions
from sparkreef.operators import lineage

#: Buckets the places of points are cut into.
BUCKETS = 64


def borders(points: DataFrame, place: Column, buckets: int = BUCKETS) -> list[float]:
    """Places that part the points into buckets of like sizes, ``buckets`` - 1 at most: one aggregate."""
    found = points.agg(F.percentile_approx(place, [i / buckets for i in range(1, buckets)], 100 * buckets).alias("p")).first()["p"]
    return sorted(set(found or []))


def range_join(points: DataFrame, ranges: DataFrame, on: Sequence[str], place: Column, first: Column, last: Column, inside: Column, cuts: list[float]) -> DataFrame:
    """``points`` with each of the ``ranges`` they lie in, that agree in the columns ``on``.

    ``place`` of a point, ``first`` and ``last`` of a range (null: open) are numbers in the order of what
    ``inside`` compares, so that what is inside lies between them; ``inside`` decides. Ranges are cut
    at the borders ``cuts``, one row for each bucket they reach into, and meet the points of that
    bucket only. Where a range covers a bucket all that meets is a result, so that the join works in
    proportion to points, results and ranges times buckets. A hot key of ``on`` is parted by its
    buckets, and Spark splits what is still large. Null keys match nothing.
    """
    edges = F.array(*map(F.lit, cuts)).cast("array<double>")

    def bucket(value: Column) -> Column:
        return F.size(F.filter(edges, lambda e: e <= value))

    own = points.withColumn("_bucket", F.when(place.isNotNull(), bucket(place)))
    reach = F.sequence(F.coalesce(bucket(first), F.lit(0)), F.when(last.isNull(), len(cuts)).otherwise(bucket(last)))
    cut = ranges.where(first.isNull() | last.isNull() | (first <= last)).withColumn("_bucket", F.explode(reach))
    return own.join(cut, [*on, "_bucket"]).where(inside).drop("_bucket")


def affected(components: DataFrame, advisories: DataFrame, product: str, version: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(components' and advisories' columns): which advisory's range of versions a component lies in, each once.

    ``product`` is in both, ``version`` of components, ``text``, a range, of advisories. Versions and
    ranges that can't be read match nothing; ``unread`` tells which these are. Rows that repeat match
    as often as they stand there.
    """
    # What is read, met and compared are the distinct versions and ranges of a product; rows only join the classes
    # they belong to, so that rows that repeat cost no more than the results they give.
    # Checkpoints keep filters on what is read from being pushed below the distinct rows.
    own = lineage.checkpointed(components.select(product, version).distinct())
    told = lineage.checkpointed(advisories.select(product, text).distinct())
    keyed = own.withColumn("_key", versions.version_key(F.col(version)))
    spans = unfolded(told, text).where("_span is not null")
    spans = spans.select("*", F.col("_span.lo").alias("_lo"), F.col("_span.hi").alias("_hi"), F.col("_span.but").alias("_but")).drop("_span")
    at, first, last = (versions.place(F.col(c)) for c in ("_key", "_lo", "_hi"))
    open_low, open_high = F.length("_lo") < 2, F.substring("_hi", 2, 1) == versions.HIGHEST
    point = F.concat("_key", F.lit("m"))
    inside = (F.col("_lo") < point) & (point < F.col("_hi")) & ~F.array_contains("_but", F.col("_key"))
    known = keyed.where(F.col("_key").isNotNull())
    cuts = borders(known, at, buckets)
    met = range_join(known, spans, [product], at, F.when(~open_low, first), F.when(~open_high, last), inside, cuts)
    # alternatives of one range may overlap: the first that holds is enough
    once = met.where(~F.exists("_earlier", lambda s: (s["lo"] < point) & (point < s["hi"]) & ~F.array_contains(s["but"], F.col("_key"))))
    told_of = components.join(lineage.checkpointed(once.select(product, version, text)), [product, version])
    found = lineage.dealt(told_of, product, text).join(lineage.dealt(advisories, product, text), [product, text])
    return found.select(product, *(c for c in [*components.columns, *advisories.columns] if c != product))


def unfolded(advisories: DataFrame, text: str) -> DataFrame:
    """A row for each interval of a range, _span, with those before it, _earlier; null if it can't be read."""
    read = advisories.withColumn("_all", versions.intervals(F.col(text)))
    rows = read.select("*", F.posexplode_outer("_all").alias("_at", "_span"))
    return rows.withColumn("_earlier", F.slice("_all", 1, F.coalesce("_at", F.lit(0)))).drop("_all", "_at")


def unread(advisories: DataFrame, text: str) -> DataFrame:
    """The advisories whose ranges can't be read, for a person to look at."""
    return advisories.where(versions.intervals(F.col(text)).isNull())
