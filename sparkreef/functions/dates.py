"""Dates: feeds write RFC 822 or ISO 8601; everything here is UTC. Sessions must run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """RFC 822, weekday or not, or ISO 8601, as a timestamp; naive is UTC; null if it is neither.

    Two-digit years from 69 on are of the last century.
    """
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(bare, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    short = r"^(\d{1,2} [A-Za-z]{3}) (\d{2}) (.*)$"
    year = F.regexp_extract(zone, short, 2).try_cast("int")
    century = F.when(year >= 69, "19").otherwise("20")
    full = F.when(
        zone.rlike(short),
        F.concat(
            F.regexp_extract(zone, short, 1), F.lit(" "), century, F.regexp_extract(zone, short, 2), F.lit(" "), F.regexp_extract(zone, short, 3)
        ),
    ).otherwise(zone)
    return F.coalesce(
        F.try_to_timestamp(full, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(text).try_cast("timestamp")),
    )


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def checked_timestamp(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` or a bare date (its midnight); null for any other form."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$")
    return F.when(shaped, text.try_cast("timestamp"))


def window_start(since: Column, now: Column, slack_h: int = 48, look_back_d: int = 14, most_d: int = 30) -> Column:
    """Where collection begins: slack before the last success, or the default look-back if there was
    none, and never over ``most_d`` days ago."""
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    begin = F.coalesce(since - hours(slack_h), now - hours(24 * look_back_d))
    return F.greatest(begin, now - hours(24 * most_d))


def seconds_between(a: Column, b: Column) -> Column:
    """Seconds from ``a`` to ``b``, with the fraction."""
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def age(seconds: Column) -> Column:
    """Seconds as 5s, 5m, 5h or 5d, whole units."""

    def unit(size: int, name: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(name))

    return (
        F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
    )
