"""Numbers, limits, JSON, macros, versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(text: Column) -> Column:
    """A double; null if it isn't a number, or is NaN or infinite."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def clamped(text: Column, low: float, high: float, default: float) -> Column:
    """A number held within bounds; the default where there is none."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.coalesce(finite(text), F.lit(float(default)))))


def padded(n: Column, to: int) -> Column:
    """The next multiple of ``to``."""
    return (n + (to - 1)) - F.pmod(n + (to - 1), F.lit(to))


def as_limit(text: Column) -> Column:
    """A JSON scalar as a positive whole number: 5, 5.0 and "5" are; true, 0, -1 and 5.5 aren't."""
    bare = F.regexp_extract(text, r'^\s*"?\+?(\d+)(?:\.0+)?"?\s*$', 1)
    quoted_float = text.rlike(r'^\s*"[^"]*\.')
    value = F.when(~quoted_float, F.nullif(bare, F.lit("")).try_cast("long"))
    return F.when(value > 0, value)


def cap_output(asked: Column, default: int, most: int) -> Column:
    """struct<limit, change>: the limit that holds and how it came about."""
    limit = F.least(F.coalesce(asked, F.lit(default)), F.lit(most)).cast("long")
    change = F.when(asked.isNull(), "default").when(asked > most, "capped").otherwise("kept")
    return F.struct(limit.alias("limit"), change.alias("change"))


def tensor_bytes(elements: Column, block: Column, block_bytes: Column) -> Column:
    """Bytes of a tensor in blocks; null if its elements don't fill whole blocks."""
    return F.when(F.pmod(elements, block) == 0, F.floor(elements / block) * block_bytes).cast("long")


def speed_class(rate: Column) -> Column:
    return F.when(rate > 80, "A").when(rate > 30, "B").when(rate > 10, "C").otherwise("D")


def chunk_limit(ceiling: Column, overhead: int = 512, each: int = 240, least: int = 1, most: int = 40) -> Column:
    """How many items fit a reply budget."""
    fit = F.floor((ceiling - overhead) / each)
    return F.least(F.lit(most), F.greatest(F.lit(least), fit)).cast("int")


def outermost_object(text: Column) -> Column:
    """The JSON object in a reply: as it is, inside a code fence, or from the first { to the last }."""
    fenced = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    cut = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(fenced).isNotNull(), fenced).when(F.try_parse_json(cut).isNotNull() & (cut != ""), cut)


def expand_macros(text: Column, macros: Mapping[str, str], passes: int = 3) -> Column:
    """``${name}`` replaced, so many times over; unknown names stay."""
    for _ in range(passes):
        for name, value in macros.items():
            text = F.replace(text, F.lit("${" + name + "}"), F.lit(value))
    return text


def command_flag(command: Column, flag: str) -> Column:
    """The value after a flag; null without it."""
    return F.nullif(F.regexp_extract(command, rf"(?:^|\s){flag}[ =](\S+)", 1), F.lit(""))


def version(text: Column) -> Column:
    """A struct that compares as versions do: kind, four numbers, then releases after candidates.

    Build tags (b1234) are a kind of their own; what isn't a version is null.
    """
    bare = F.regexp_replace(F.trim(text), r"^v\.?|-stable$", "")
    dotted = r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:\.(\d+))?(?:-?rc\.?(\d+))?$"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(bare, dotted, i), F.lit("")).try_cast("long"), F.lit(0).cast("long"))

    candidate = F.regexp_extract(bare, dotted, 5)
    build = F.regexp_extract(F.trim(text), r"^b(\d+)$", 1)
    zero = F.lit(0).cast("long")
    return F.when(
        build != "",
        F.struct(
            F.lit("build").alias("kind"), build.try_cast("long").alias("n0"), zero.alias("n1"), zero.alias("n2"), zero.alias("n3"),
            F.lit(1).alias("final"), zero.alias("candidate"),
        ),
    ).when(
        bare.rlike(dotted),
        F.struct(
            F.lit("semver").alias("kind"), part(1).alias("n0"), part(2).alias("n1"), part(3).alias("n2"), part(4).alias("n3"),
            F.when(candidate == "", 1).otherwise(0).alias("final"), part(5).alias("candidate"),
        ),
    )


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null across kinds and for what isn't a version."""
    return F.when(a["kind"] == b["kind"], F.when(a < b, -1).when(a > b, 1).otherwise(0))


def in_range(subject: Column, terms: Sequence[Sequence[tuple[str, str]]]) -> Column:
    """Whether a version meets any of the alternatives, each a list of (operator, version) that must
    all hold. Three-valued: null where a comparison is and the others don't decide."""
    tests = {"<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0, "=": lambda c: c == 0}
    any_ = F.lit(False)
    for alternative in terms:
        all_ = F.lit(True)
        for operator, bound in alternative:
            all_ = all_ & tests[operator](compare_versions(subject, version(F.lit(bound))))
        any_ = any_ | all_
    return any_


def expected_width(spec: str, device: Column, default: int) -> Column:
    """The width that a spec such as ``0=16,1=8`` names for a device; one number alone is for all.

    Parts that aren't ``number=number`` count for nothing, and the last of two for one device does.
    """
    parts = [part.strip() for part in spec.split(",")]
    if len(parts) == 1 and parts[0].isdigit():
        default, parts = int(parts[0]), []
    named = {}
    for part in parts:
        left, _, right = part.partition("=")
        if left.strip().isdigit() and right.strip().isdigit():
            named[int(left)] = int(right)
    width = F.lit(default)
    for number, value in named.items():
        width = F.when(device == number, value).otherwise(width)
    return width
