"""URL filtering by association rules, with DataFrame functions and Spark's FP-growth alone.

A list of (host, path, verdict) rules judges what it fits; FP-growth mines combinations of URL
tokens that go with a label, and what no list rule fits is judged by the mined rules. All tokens of
a URL are kept, however deep its path. What is mined is bounded without regard to the corpus: each
itemset is held by a share of the labelled URLs of at least MIN_SUPPORT, and of a labelled URL's
tokens the MOST_TOKENS that go furthest with one label make its basket, so an antecedent has no more
than these. A mined rule is indexed under the token of its that the fewest URLs have; URLs meet
rules there and are then held against the whole antecedent. Matching works on distinct token sets,
so that a host with a third of all pages is a few rows.

A null url, or one without ``://``, has an empty host and path and no tokens: no rule fits it and
the verdict is the default. Repeated pages get the same verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreef.llm.common import checkpointed

#: (host, path, verdict): fits the host and its subdomains, and paths that start with the path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"

#: A labelled URL is mined by so many of its tokens at most.
MOST_TOKENS = 12
MIN_SUPPORT = 0.002
#: A rule rests on this many labelled URLs at least.
MIN_COUNT = 20
MIN_CONFIDENCE = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to the first of / ? #, path up to ? or #; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def list_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    chain = F.lit(None)
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found).otherwise(chain)
    return chain


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: its domain and the labels before it, path segments by place with
    numbers alike, query keys, scheme."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.regexp_replace(x, r"\d+", "#"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    return F.array_distinct(
        F.concat(
            F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("host"), i, F.lit(":"), x)),
            F.transform(segments, lambda x, i: F.concat(F.lit("path"), i, F.lit(":"), x)),
            F.transform(F.filter(keys, lambda x: x != ""), lambda x: F.concat(F.lit("key:"), x)),
            F.when(host != "", F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1))))).otherwise(
                F.array().cast("array<string>")
            ),
        )
    )


def telling_tokens(labelled: DataFrame, n: int, least: float, most_tokens: int) -> DataFrame:
    """(tokens, chosen) for each distinct token set of ``labelled`` (tokens, label), ``n`` rows: those
    of its tokens that at least ``least`` rows have, the ``most_tokens`` furthest from the labels'
    overall shares, counted in deviations."""
    shares = labelled.groupBy("label").agg((F.count("*") / n).alias("share"))
    told = labelled.select(F.explode("tokens").alias("token"), "label").groupBy("token", "label").agg(F.count("*").alias("both"))
    held = told.groupBy("token").agg(F.sum("both").alias("held")).where(F.col("held") >= least)
    far = F.max(F.abs(F.col("both") - F.col("held") * F.col("share")) / F.sqrt("held"))
    scores = told.join(held, "token").join(shares, "label").groupBy("token").agg(far.alias("far"))
    spread = labelled.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(scores, "token")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("far"), "token")))
    return spread.groupBy("tokens").agg(F.slice(F.transform(ordered, lambda x: x["token"]), 1, most_tokens).alias("chosen"))


def mine_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """(tokens, label, confidence, support) mined from ``labelled`` (tokens, label).

    A rule stays only if no rule with the same label and fewer tokens, all among its own, is as
    confident.
    """
    n = labelled.count()
    chosen = telling_tokens(labelled, max(n, 1), max(min_support * n, min_count), most_tokens)
    kept = labelled.join(chosen, "tokens", "left").select(F.coalesce("chosen", F.array().cast("array<string>")).alias("tokens"), "label")
    baskets = kept.select(F.concat("tokens", F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / max(n, 1))), minConfidence=min_confidence)
    rules = growth.fit(baskets).associationRules
    is_label = F.col("consequent")[0].startswith("label:")
    clean = ~F.exists("antecedent", lambda x: x.startswith("label:"))
    mined = checkpointed(
        rules.where(is_label & clean).select(
            F.sort_array("antecedent").alias("tokens"),
            F.substring(F.col("consequent")[0], 7, 1_000_000).alias("label"),
            "confidence",
            "support",
        )
    )
    # Shorter rules are met by one token, as the pages will be.
    shorter = mined.select(F.explode("tokens").alias("token"), F.struct("tokens", "label", "confidence").alias("short"))
    longer = mined.select("*", F.explode("tokens").alias("token"))
    beaten = (
        longer.join(shorter, "token")
        .where(
            (F.col("short.label") == F.col("label"))
            & (F.size("short.tokens") < F.size("tokens"))
            & (F.col("short.confidence") >= F.col("confidence"))
            & (F.size(F.array_except("short.tokens", "tokens")) == 0)
        )
        .select("tokens", "label")
        .distinct()
    )
    return mined.join(beaten, ["tokens", "label"], "left_anti")


def matched_labels(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, label) for each distinct token set that a mined rule fits: the most confident rule's,
    then the best supported, then the first in order."""
    spread = rules.select("*", F.explode("tokens").alias("token"))
    used = spread.select("token").distinct()
    held = token_sets.select(F.explode("tokens").alias("token")).join(used, "token", "left_semi").groupBy("token").count()
    spread = spread.join(held, "token")  # a rule with a token that no set has fits none
    index = spread.groupBy("tokens", "label", "confidence", "support").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    index = index.select("token", F.struct("tokens", "label", "confidence", "support").alias("rule"))
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = met.where(F.size(F.array_except("rule.tokens", "tokens")) == 0)
    best = F.max(F.struct("rule.confidence", "rule.support", "rule.label", "rule.tokens"))
    return fits.groupBy("tokens").agg(best["label"].alias("label"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``.

    ``labels`` (url, label: allow or block) are what is mined; without any, the pages that the list
    judges are.
    """

    def parted(df: DataFrame) -> DataFrame:
        host, path = url_parts(F.col(url_col))
        df = df.withColumns({"host": host, "path": path})
        return df.withColumn("tokens", url_tokens(F.col(url_col), F.col("host"), F.col("path")))

    own = parted(pages.select(id_col, url_col)).withColumn("listed", list_rule(F.col("host"), F.col("path"), rules))
    own = checkpointed(own.drop(url_col))
    if labels is None:
        labelled = own.where("listed is not null").select("tokens", F.col("listed.verdict").alias("label"))
    else:
        labelled = parted(labels.where(F.col("label").isNotNull())).select("tokens", "label")
    mined = checkpointed(mine_rules(labelled))
    matched = matched_labels(own.where("listed is null").select("tokens").distinct(), mined)
    return own.join(matched.withColumnRenamed("label", "mined"), "tokens", "left").select(
        id_col,
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined", F.lit(DEFAULT)).alias("verdict"),
    )
