"""Versions as strings that sort as they do, and advisories' ranges as intervals of such strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How candidates rank before a release. Fixed values.
RANKS = {"dev": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "pre": 3, "preview": 3, "rc": 3, "c": 3}
_RELEASE = 9

_DOTTED = r"(?i)^(\d+(?:\.\d+)*)(?:[-.]?(?:stable|final|release|ga))?(?:[-.]?(dev|alpha|beta|preview|pre|rc|a|b|c)[-.]?(\d*))?(?:\+[\w.]+)?$"
#: Numbers a version has, and digits a number has: longer ones are no versions.
PARTS, DIGITS = 4, 9

#: Stand before and behind everything that a version of a kind can be.
LOWEST, HIGHEST = "", "~"


def version_key(text: Column) -> Column:
    """A string that sorts as versions do, null if ``text`` is none: its kind (s dotted, b a build's
    number), then four numbers, the rank of a candidate and its number, all in fixed widths.

    ``v1.2.3``, ``v.2.8.0``, ``1.83.10-stable``, ``1.104.0rc1`` are dotted; ``b8145`` is a build. Marks of
    comparison before a version, and quotes around it, count for nothing.
    """
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(text), "^['\"]+|['\"]+$", "")), r"^[=<>!~^ ]+", "")
    bare = F.regexp_replace(bare, r"(?i)^v\.?", "")
    build = F.regexp_extract(bare, r"(?i)^b(\d+)$", 1)
    numbers = F.split(F.regexp_extract(bare, _DOTTED, 1), r"\.")
    rank = F.lower(F.regexp_extract(bare, _DOTTED, 2))
    ranked = F.lit(_RELEASE)
    for word, place in RANKS.items():
        ranked = F.when(rank == word, place).otherwise(ranked)
    plain = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    wide = lambda x: F.lpad(plain(F.coalesce(F.nullif(x, F.lit("")), F.lit("0"))), DIGITS, "0")
    candidate = F.regexp_extract(bare, _DOTTED, 3)
    first = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: wide(F.get(numbers, i)))
    fits = ~F.exists(F.concat(numbers, F.array(candidate, build)), lambda x: F.length(plain(x)) > DIGITS)
    dotted = F.concat(F.lit("s"), F.array_join(first, "."), F.lit("-"), ranked.cast("string"), F.lit("."), wide(candidate))
    return F.when(~fits, F.lit(None).cast("string")).when(build != "", F.concat(F.lit("b"), wide(build))).when(bare.rlike(_DOTTED), dotted)


def place(key: Column) -> Column:
    """A number that is never less for a later key of the same kind: what buckets are cut by."""
    number = lambda at: F.coalesce(F.substring(key, at, DIGITS).try_cast("double"), F.lit(0.0))
    return number(2) * 1e6 + F.least(number(12), F.lit(999.0)) * 1e3 + F.least(number(22), F.lit(999.0))


def _alternatives(text: Column) -> Column:
    """The parts of a range of which one has to hold."""
    norm = F.regexp_replace(text, r"(?i)\s*(;|\|\||\bor\b)\s*", "||")
    norm = F.regexp_replace(norm, r"(?i)\s+and\s+", " ")

    def parted(alternative: Column) -> Column:
        parts = F.filter(F.transform(F.split(alternative, ","), lambda p: F.trim(p)), lambda p: p != "")
        signs = lambda p: F.size(F.regexp_extract_all(p, F.lit("[<>]=?|==|!="), F.lit(0)))
        apart = F.forall(parts, lambda p: signs(p) == 0) | F.exists(parts, lambda p: signs(p) >= 2)
        return F.when((F.size(parts) > 1) & apart, parts).otherwise(F.array(alternative))

    return F.flatten(F.transform(F.split(norm, r"\|\|"), parted))


def _bounds(alternative: Column) -> Column:
    """The bounds of one alternative: (sign, key) structs."""
    span = r"^\s*(\S+)\s+-\s+(\S+)\s*$"
    bound = lambda sign, version: F.struct(sign.alias("sign"), version_key(version).alias("key"))
    terms = F.filter(F.split(alternative, r",|\s+(?=[<>=!])"), lambda t: F.trim(t) != "")
    one = r"^\s*(>=|<=|==|!=|>|<|=)?\s*(.+?)\s*$"
    told = F.transform(terms, lambda t: bound(F.regexp_extract(t, one, 1), F.regexp_extract(t, one, 2)))
    both = F.array(bound(F.lit(">="), F.regexp_extract(alternative, span, 1)), bound(F.lit("<="), F.regexp_extract(alternative, span, 2)))
    return F.when(alternative.rlike(span), both).otherwise(told)


def intervals(text: Column) -> Column:
    """The intervals of a range: an array of (lo, hi, but), null where the range can't be read.

    A version of key k lies inside if ``lo < k || 'm' < hi`` and k isn't in ``but``. Alternatives
    are parted by ``;``, ``||`` or ``or``, and by commas between whole versions or whole ranges; bounds
    by commas, blanks or ``and``; ``a - b`` has both ends in it, a version alone is that version.
    Bounds of two kinds in one alternative can't be compared, so that the range can't be read.
    """
    read = F.transform(F.filter(_alternatives(text), lambda a: F.trim(a) != ""), _bounds)
    wrong = F.exists(
        read, lambda bs: (F.size(bs) == 0) | F.exists(bs, lambda b: b["key"].isNull() | (F.substring(b["key"], 1, 1) != F.substring(bs[0]["key"], 1, 1)))
    )

    def narrowed(bounds: Column) -> Column:
        kind = F.substring(bounds[0]["key"], 1, 1)
        # an end lies before or behind all that stands at its version, as a before m before z
        low = F.transform(
            F.filter(bounds, lambda b: b["sign"].isin(">", ">=", "=", "==", "")),
            lambda b: F.concat(b["key"], F.when(b["sign"] == ">", "z").otherwise("a")),
        )
        high = F.transform(
            F.filter(bounds, lambda b: b["sign"].isin("<", "<=", "=", "==", "")),
            lambda b: F.concat(b["key"], F.when(b["sign"] == "<", "a").otherwise("z")),
        )
        but = F.transform(F.filter(bounds, lambda b: b["sign"] == "!="), lambda b: b["key"])
        return F.struct(
            F.coalesce(F.array_max(low), F.concat(kind, F.lit(LOWEST))).alias("lo"),
            F.coalesce(F.array_min(high), F.concat(kind, F.lit(HIGHEST))).alias("hi"),
            but.alias("but"),
        )

    return F.when((F.size(read) > 0) & ~wrong, F.transform(read, narrowed))
