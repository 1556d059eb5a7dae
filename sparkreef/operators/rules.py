"""Ordered policies, patterns, access predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreef.functions.text import EDGE


def glob(pattern: str) -> str:
    """An anchored regular expression: * is anything, ? one character, the rest is itself."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the path or its last part matches one of the globs."""
    base = F.substring_index(path, "/", -1)
    found = F.lit(False)
    for p in patterns:
        found = found | path.rlike(glob(p)) | base.rlike(glob(p))
    return found


def first_rule(subject: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The action of the first (glob, action) that matches."""
    action = F.lit(default)
    for pattern, name in reversed(rules):
        action = F.when(subject.rlike(glob(pattern)), name).otherwise(action)
    return action


def scanned(lines: DataFrame, text: str, fixed: Sequence[str], words: Sequence[str], shapes: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Rows with the array hits: fixed strings, whole words in either case, shapes that no exclusion fits."""
    t = F.col(text)
    hits = [F.when(t.contains(f), f"fixed:{f}") for f in fixed]
    hits += [F.when(t.rlike(rf"(?i){EDGE}{re.escape(w)}{EDGE}"), f"word:{w}") for w in words]
    allowed = F.lit(True)
    for e in excluded:
        allowed = allowed & ~t.rlike(e)
    hits += [F.when(t.rlike(s) & allowed, f"shape:{i}") for i, s in enumerate(shapes)]
    return lines.withColumn("hits", F.array_compact(F.array(*hits))).where(F.size("hits") > 0)


def restricted(name: Column, word: str, routes: Sequence[str]) -> Column:
    """Whether a segment of the name, routes stripped, is ``word`` or begins with ``word-``."""
    bare = F.regexp_replace(F.lower(name), f"^(?:(?:{'|'.join(map(re.escape, routes))})/)+", "")
    return F.exists(F.split(bare, "/"), lambda s: (s == word) | s.startswith(word + "-"))


def allowed(name: Column, patterns: Sequence[str]) -> Column:
    """Whether a wildcard list admits the name."""
    found = F.lit(False)
    for p in patterns:
        found = found | name.rlike(glob(p))
    return found
