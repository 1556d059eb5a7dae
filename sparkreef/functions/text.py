"""Text: keys, clean-up, truncation, escaping, classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities that are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

#: A word's edge where ASCII letters, digits and _ make words, as in SQL; Java's \b knows letters beyond.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def norm_key(text: Column, size: int = 60) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one dash, none at the ends, cut to ``size``."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, size)


def strip_tags(html: Column) -> Column:
    """Without tags, blanks collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def ellipsis(text: Column, size: int) -> Column:
    """At most ``size`` characters; a cut text loses its trailing spaces and ends in an ellipsis."""
    cut = F.concat(F.rtrim(F.substring(text, 1, size - 1)), F.lit("…"))
    return F.when(F.length(text) <= size, text).otherwise(cut)


def unescape(text: Column) -> Column:
    for entity, letter in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return text


def host_and_path(url: Column) -> Column:
    """Host and path of an http(s) URL, without query and fragment; empty for others."""
    return F.regexp_extract(url, r"^https?://([^?#]*)", 1)


def markdown_safe(text: Column) -> Column:
    """Backslashes before the characters that Markdown reads."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def table_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def header_value(text: Column, size: int = 96) -> Column:
    """Only word characters (ASCII), dots, at signs, pluses, dashes and spaces, cut to ``size``."""
    return F.substring(F.regexp_replace(text, "[^0-9A-Za-z_.@+ -]", ""), 1, size)


def scrub(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    for pattern, mask in patterns:
        text = F.regexp_replace(text, pattern, mask)
    return text


def without_route(name: Column, routes: Sequence[str]) -> Column:
    """Lower case, trimmed, without any leading run of ``route/`` prefixes."""
    return F.trim(F.regexp_replace(F.lower(F.trim(name)), f"^(?:(?:{'|'.join(routes)})/\\s*)+", ""))


def image_reference(ref: Column) -> Column:
    """struct<registry, repository, tag, digest> with the usual defaults."""
    bare = F.regexp_replace(ref, "@.*$", "")
    digest = F.nullif(F.regexp_extract(ref, "@(.+)$", 1), F.lit(""))
    tag = F.nullif(F.regexp_extract(bare, ":([^:/]+)$", 1), F.lit(""))
    path = F.regexp_replace(bare, ":[^:/]+$", "")
    first = F.regexp_extract(path, "^([^/]+)/", 1)
    named = first.rlike(r"[.:]") | (first == "localhost")
    repository = F.when(named, F.regexp_replace(path, "^[^/]+/", "")).otherwise(path)
    return F.struct(
        F.when(named, first).otherwise("docker.io").alias("registry"),
        F.when(~named & ~path.contains("/"), F.concat(F.lit("library/"), repository)).otherwise(repository).alias("repository"),
        F.when(tag.isNull() & digest.isNull(), "latest").otherwise(tag).alias("tag"),
        digest.alias("digest"),
    )


def first_match(text: Column, ladder: Sequence[tuple[str, str]], default: str) -> Column:
    """The class of the first pattern that the text has."""
    found = F.lit(default)
    for pattern, name in reversed(ladder):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def flags(rules: Sequence[tuple[str, Column]]) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in rules)))


def advisory_id(text: Column) -> Column:
    """The first CVE, GHSA, CERT-Bund, ICS or RUSTSEC style id, upper-cased; null without one."""
    pattern = (
        EDGE + r"(?i)(CVE-\d{4}-\d{4,}|GHSA(?:-[0-9a-z]{4}){3}|WID-SEC-\d{4}-\d+|ICSM?A-\d{2}-\d{3}-\d{2}|RUSTSEC-\d{4}-\d{4})" + EDGE
    )
    return F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit(""))


def arxiv_id(*candidates: Column) -> Column:
    """The id in the first candidate that has one, by URL or OAI name; null without one."""
    pattern = r"(?:arxiv\.org/(?:abs|pdf)/|oai:arXiv\.org:)(\d{4}\.\d{4,5})"
    return F.coalesce(*(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")) for c in candidates))


def item_key(title: Column, link: Column) -> Column:
    """What makes feed items the same: an advisory id in either, else the link, else the clean title."""
    return F.coalesce(
        advisory_id(F.concat_ws(" ", title, link)), F.nullif(F.trim(link), F.lit("")), F.lower(strip_tags(title))
    )


def short_digest(text: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, size)
