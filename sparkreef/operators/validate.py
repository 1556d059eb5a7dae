"""Constraints as columns: every problem of a row, not just the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_number(column: str, low: int, high: int) -> tuple[Column, str]:
    return ~F.coalesce(F.col(column).between(low, high), F.lit(False)), f"{column}: not within {low} to {high}"


def choice(column: str, values: Sequence[str]) -> tuple[Column, str]:
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False)), f"{column}: not one of {', '.join(values)}"


def shape(column: str, pattern: str) -> tuple[Column, str]:
    return ~F.coalesce(F.col(column).rlike(pattern), F.lit(False)), f"{column}: malformed"


def implied(condition: Column, consequence: Column, message: str) -> tuple[Column, str]:
    return F.coalesce(condition, F.lit(False)) & ~F.coalesce(consequence, F.lit(False)), message


def violations(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """``df`` with the array problems, in the order of the rules."""
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(broken, message) for broken, message in rules))))


def compiled(schema: dict[str, dict]) -> list[tuple[Column, str]]:
    """Rules from a subset of JSON Schema by column: const, enum, pattern, minimum, maximum, required."""
    rules = []
    for column, parts in schema.items():
        value = F.col(column)
        tests = {
            "const": lambda x, v=value: v == F.lit(x),
            "enum": lambda x, v=value: v.isin(*x),
            "pattern": lambda x, v=value: v.rlike(x),
            "minimum": lambda x, v=value: v >= x,
            "maximum": lambda x, v=value: v <= x,
            "required": lambda x, v=value: v.isNotNull() | F.lit(not x),
        }
        for name, wanted in parts.items():
            rules.append((~F.coalesce(tests[name](wanted), F.lit(False)), f"{column}: {name}"))
    return rules
