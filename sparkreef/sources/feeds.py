"""Feeds as tables: RSS, Atom and RDF, catalogs and change indexes, each body a row.

Spark's own XML and JSON functions read them. What can't be read becomes an error in the row, never
an exception. A feed without items is valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.functions import dates

# Where a date and a description are looked for, in this order.
DATE_TAGS = ("pubDate", "date", "published", "updated", "issued", "modified")
ABOUT_TAGS = ("description", "summary", "encoded", "content")
ROOTS = ("rss", "feed", "RDF")

_TEXTS = ("title", "guid", "id", *DATE_TAGS, *ABOUT_TAGS, "announce_type", "_about")
_ENTRY = f"array<struct<link:array<struct<_VALUE:string,_href:string,_rel:string>>,{','.join(f'`{x}`:string' for x in _TEXTS)}>>"
_FEED = f"channel struct<item:{_ENTRY}>, item {_ENTRY}, entry {_ENTRY}, _bad string"


def _said(entry: Column, *names: str) -> Column:
    """The first of these fields that says anything, blanks collapsed; else the empty text."""
    found = [F.nullif(F.trim(F.regexp_replace(entry[name], r"\s+", " ")), F.lit("")) for name in names]
    return F.coalesce(*found, F.lit(""))


def _link(entry: Column) -> Column:
    """The alternate of the links that are attributes, or the first of them; without any the link's
    text, else an http guid or id, else what the entry is about."""
    attributes = F.filter(entry["link"], lambda x: x["_href"].isNotNull())
    alternate = F.filter(attributes, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    text = F.filter(F.transform(entry["link"], lambda x: F.trim(x["_VALUE"])), lambda x: x != "")
    guid = _said(entry, "guid", "id")
    return F.coalesce(
        F.get(alternate, F.lit(0))["_href"],
        F.get(attributes, F.lit(0))["_href"],
        F.get(text, F.lit(0)),
        F.when(guid.rlike("^https?://"), guid),
        _said(entry, "_about"),
    )


def parsed_feeds(bodies: DataFrame, body: str) -> DataFrame:
    """``bodies`` with ok, error and items: (title, link, date, about, announced) of each entry that has a
    title or a link. A byte order mark and leading blanks are no error, entities are."""
    text = F.regexp_replace(body, "^[\\uFEFF\\s]+", "")
    root = F.regexp_extract("_text", r"(?s)^(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = bodies.withColumn("_text", F.coalesce(text, F.lit("")))
    refused = F.when(~F.col("_text").startswith("<") | F.col("_text").rlike("(?i)^<(!doctype|html)"), "not a feed").when(
        F.col("_text").contains("<!ENTITY"), "entities are refused"
    )
    rows = rows.withColumns({"_refused": refused, "_root": root})
    rows = rows.withColumn("_xml", F.from_xml(F.when(F.col("_refused").isNull(), F.col("_text")), _FEED, options))
    error = (
        F.when(F.col("_refused").isNotNull(), F.col("_refused"))
        .when(F.col("_xml._bad").isNotNull(), "malformed")
        .when(~F.col("_root").isin(*ROOTS), F.concat(F.lit("not a feed: "), "_root"))
    )
    none = F.array().cast(_ENTRY)
    parts = [F.coalesce(F.col(f"_xml.{x}"), none) for x in ("channel.item", "item", "entry")]
    told = F.transform(
        F.concat(*parts),
        lambda e: F.struct(
            _said(e, "title").alias("title"), _link(e).alias("link"), _said(e, *DATE_TAGS).alias("date"),
            _said(e, *ABOUT_TAGS).alias("about"), _said(e, "announce_type").alias("announced"),
        ),
    )
    kept = F.filter(told, lambda e: (e["title"] != "") | (e["link"] != ""))
    rows = rows.withColumn("error", error)
    items = F.when(F.col("error").isNull(), kept).otherwise(F.filter(kept, lambda e: F.lit(False)))
    return rows.select(*bodies.columns, F.col("error").isNull().alias("ok"), "error", items.alias("items"))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """(path, ok, error, items) of each file: whole bodies are read by Spark, a row each."""
    bodies = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_body"))
    return parsed_feeds(bodies, "_body").drop("_body")


def feed_items(feeds: DataFrame, source: str = "path") -> DataFrame:
    """(source, place, title, link, at, about): a row per item, in document order, dates as timestamps.

    Nothing is asked of a feed before its items stand apart: a filter on what was read would make Spark
    read bodies where they come from, before they are dealt out to tasks.
    """
    items = F.posexplode_outer(F.when(F.col("ok"), F.col("items"))).alias("place", "i")
    rows = feeds.select(F.col(source).alias("source"), items).where("place is not null")
    return rows.select("source", "place", "i.title", "i.link", dates.parse_date(F.col("i.date")).alias("at"), "i.about")


_CATALOG = (
    "catalogVersion string, vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,"
    "dateAdded:string,dueDate:string,knownRansomwareCampaignUse:string,requiredAction:string>>"
)


def bodies_at(spark: SparkSession, path: str) -> DataFrame:
    """(body) of each file, whole."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def catalog_entries(bodies: DataFrame, body: str, most: int = 25) -> DataFrame:
    """The ``most`` newest entries of each JSON catalog of exploited vulnerabilities, with its version, its
    total and their rank."""
    catalogs = bodies.select(F.from_json(body, _CATALOG).alias("c")).select("c.catalogVersion", F.size("c.vulnerabilities").alias("total"), F.col("c.vulnerabilities").alias("v"))
    newest = F.array_sort("v", lambda x, y: F.when(x["dateAdded"] > y["dateAdded"], -1).when(x["dateAdded"] < y["dateAdded"], 1).when(x["cveID"] < y["cveID"], -1).when(x["cveID"] > y["cveID"], 1).otherwise(0))
    rows = catalogs.select("catalogVersion", "total", F.posexplode(F.slice(newest, 1, most)).alias("place", "e"))
    return rows.select("catalogVersion", "total", (F.col("place") + 1).alias("rank"), "e.*")


def read_catalog(spark: SparkSession, path: str, most: int = 25) -> DataFrame:
    return catalog_entries(bodies_at(spark, path), "body", most).drop("rank")


def change_lines(lines: DataFrame, line: str) -> DataFrame:
    """(path, changed) of the lines of a change index; only JSON documents."""
    rows = lines.select(F.from_csv(F.col(line), F.lit("path string, changed string")).alias("c")).select("c.*")
    return rows.where(F.col("path").endswith(".json")).select("path", dates.parse_date(F.col("changed")).alias("changed"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return change_lines(spark.read.text(path), "value")


_ADVISORY = (
    "document struct<title:string, notes:array<struct<category:string,text:string>>,"
    "references:array<struct<category:string,url:string>>, tracking:struct<id:string,current_release_date:string>>"
)


def advisory_items(bodies: DataFrame, body: str, sites: dict[str, str] | None = None) -> DataFrame:
    """(id, title, link, at, about) of advisory documents, a JSON body each; without a link of its own a
    document is at the site that the beginning of its id names."""
    rows = bodies.select(F.from_json(body, _ADVISORY).alias("r")).select("r.document")
    d = F.col("document")

    def pick(parts, category: str, name: str):
        return F.try_element_at(F.filter(parts, lambda x: x["category"] == category), F.lit(1))[name]

    own = d["tracking"]["id"]
    site = F.lit(None).cast("string")
    for begins, base in (sites or {}).items():
        site = F.when(own.startswith(begins), F.concat(F.lit(base), own)).otherwise(site)
    return rows.select(
        own.alias("id"),
        d["title"].alias("title"),
        F.coalesce(pick(d["references"], "self", "url"), site).alias("link"),
        dates.parse_date(d["tracking"]["current_release_date"]).alias("at"),
        pick(d["notes"], "summary", "text").alias("about"),
    )


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    return advisory_items(bodies_at(spark, path), "body")


def collected(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[tuple[str, str | None]]]:
    """The items of all readers that work, and each reader's error or None, in order."""
    union, states = None, []
    for name, read in readers.items():
        try:
            one = read().withColumn("source", F.lit(name))
            one.schema  # noqa: B018  resolves the plan, and so finds what can't be read
            union = one if union is None else union.unionByName(one, allowMissingColumns=True)
            states.append((name, None))
        except Exception as problem:  # noqa: BLE001  one source's failure is a row of the result
            states.append((name, str(problem).splitlines()[0]))
    return union, states

