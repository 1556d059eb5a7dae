"""Incremental feeds: documents play the items, their sources the feeds, minutes from 2024 on the dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.functions import dates, text
from sparkreef.operators import cutoff, dedupe, folds, topn
from sparkreef.plans import curators
from sparkreef.queries import query, table

BUDGET = 150
NOW = "2024-01-31 00:00:00"

_KEY_SQL = "substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60)"
_ITEMS_SQL = f"""items AS (SELECT doc_id, source, {_KEY_SQL} AS key, n_chars,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS dt, doc_id % 3 AS prio FROM documents)"""
#: Sources of even numbers have a cutoff, src5 has an empty one, the others have none of their own.
_STATE_SQL = """state AS (SELECT source, any_value(CASE WHEN source <> 'src5' THEN dt END) AS cutoff FROM (SELECT *,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM items) WHERE n = least(5, 20)
    AND (source = 'src5' OR substr(source, 4)::INT % 2 = 0) GROUP BY source)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    key = text.norm_key(F.col("text"))
    return docs.select("doc_id", "source", key.alias("key"), "n_chars", at.alias("at"), (F.col("doc_id") % 3).alias("prio"))


def source_state(found: DataFrame) -> DataFrame:
    """(source, has_cutoff, cutoff) as a run before would have left it."""
    fifth = found.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n = 5")
    number = F.substring("source", 4, 9).cast("int")
    own = fifth.where((F.col("source") == "src5") | (number % 2 == 0))
    return own.select("source", F.lit(True).alias("has_cutoff"), F.when(F.col("source") != "src5", F.col("at")).alias("cutoff"))


@query(
    f"""WITH {_ITEMS_SQL}, {_STATE_SQL}, common AS (SELECT TIMESTAMP '2024-01-01' + to_minutes(max(doc_id) // 4) AS c FROM documents),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS fw FROM items WHERE key <> ''),
    seen AS (SELECT DISTINCT key FROM items WHERE doc_id % 7 = 0),
    fresh AS (SELECT f.*, CASE WHEN s.source IS NOT NULL THEN s.cutoff ELSE c END AS cut FROM firsts f LEFT JOIN state s USING (source), common
              WHERE fw = 1 AND key NOT IN (SELECT key FROM seen)),
    turns AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC, doc_id) AS rn, max(dt) OVER (PARTITION BY source) AS head
              FROM fresh WHERE NOT coalesce(dt < cut, false)),
    picked AS (SELECT *, row_number() OVER (ORDER BY rn, head DESC, source) AS pick FROM turns)
    SELECT doc_id, source, key, epoch(dt)::BIGINT AS seconds, pick FROM picked WHERE pick <= {BUDGET}"""
)
def flow_digest_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest run: first of each key, not seen before, not before its source's cutoff, fairly chosen."""
    found = items(spark, sf_dir)
    later = F.make_dt_interval(F.lit(0), F.lit(0), F.floor(F.coalesce(F.max("doc_id"), F.lit(0)) / 4).cast("int"))
    newest = table(spark, sf_dir, "documents").agg((F.lit("2024-01-01").cast("timestamp") + later).alias("common"))
    seen = found.where("doc_id % 7 = 0").select("key").distinct()
    fresh = dedupe.unseen(dedupe.first_wins(found.where("key <> ''"), ["key"], ["doc_id"]), seen, ["key"])
    fresh = fresh.crossJoin(F.broadcast(newest))  # one row
    dated = cutoff.since_cutoff(cutoff.with_cutoffs(fresh, source_state(found), F.col("common")), "at")
    picked = topn.fair_top(dated, BUDGET, "source", "at", "doc_id")
    return picked.select("doc_id", "source", "key", F.unix_timestamp("at").alias("seconds"), "pick")


@query(
    f"""WITH {_ITEMS_SQL} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'cve' WHEN 1 THEN 'paper' ELSE 'news' END AS kind,
    CASE WHEN doc_id % 3 = 0 THEN 'CVE-2024-' || lpad(doc_id::VARCHAR, 6, '0') END AS cve,
    CASE WHEN doc_id % 3 = 1 THEN '2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') END AS arxiv_id,
    CASE WHEN doc_id % 3 = 2 THEN key END AS key, substr(d.text, 1, 260) AS about
    FROM items JOIN documents d USING (doc_id)"""
)
def p01_tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per item; what identifies it depends on its kind."""
    docs = table(spark, sf_dir, "documents")
    kind = F.element_at(F.array(F.lit("cve"), F.lit("paper"), F.lit("news")), (F.col("doc_id") % 3 + 1).cast("int"))
    padded = lambda n: F.lpad(F.col("doc_id").cast("string"), n, "0")
    rows = docs.withColumn("kind", kind)
    return rows.select(
        "doc_id",
        "kind",
        F.when(F.col("kind") == "cve", F.concat(F.lit("CVE-2024-"), padded(6))).alias("cve"),
        F.when(F.col("kind") == "paper", F.concat(F.lit("2401."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"))).alias("arxiv_id"),
        F.when(F.col("kind") == "news", text.norm_key(F.col("text"))).alias("key"),
        F.substring("text", 1, 260).alias("about"),
    )


@query(
    """SELECT source, count(*) AS n_items, max(n_chars) AS longest, CASE WHEN count(*) FILTER (lang = 'de') > 0
    THEN 'has ' || count(*) FILTER (lang = 'de') || ' de' END AS note FROM documents GROUP BY source"""
)
def p03_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row per source; an optional field is there only if it says something."""
    german = F.count_if(F.col("lang") == "de")
    note = F.when(german > 0, F.concat(F.lit("has "), german.cast("string"), F.lit(" de")))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n_items"), F.max("n_chars").alias("longest"), note.alias("note")
    )


@query(
    """SELECT doc_id, '{"id":"i' || doc_id || '","source":"' || source || '"' || CASE WHEN doc_id % 2 = 0 THEN ',"size":' || n_chars ELSE '' END || '}' AS line
    FROM documents"""
)
def p04_item_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compact JSON line per item; absent fields are left out."""
    fields = F.struct(
        F.concat(F.lit("i"), "doc_id").alias("id"), "source", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("size")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(fields).alias("line"))


@query(
    """SELECT doc_id, string_agg('s' || j || ':' || (doc_id + j), ',' ORDER BY j) AS also
    FROM documents, (SELECT unnest([1, 2]) AS j) GROUP BY doc_id"""
)
def p05_also_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    also = F.transform(F.array(F.lit(1), F.lit(2)), lambda j: F.concat_ws(":", F.concat(F.lit("s"), j), F.col("doc_id") + j))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(also, ",").alias("also"))


@query(
    """SELECT source, source || ': ' || count(*) || ' items, newest ' || max(doc_id) AS line FROM documents GROUP BY source"""
)
def p07_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))
    return counted.select("source", F.format_string("%s: %d items, newest %d", "source", "n", "newest").alias("line"))


@query(
    """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS dt FROM events)
    WHERE NOT coalesce(dt < TIMESTAMP '2024-01-20', false)"""
)
def f01_cutoff_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly older rows go, undated ones stay."""
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("at"))
    return cutoff.since_cutoff(rows.withColumn("cutoff", F.lit("2024-01-20").cast("timestamp")), "at").select("event_id")


@query(
    """SELECT doc_id FROM documents WHERE doc_id % 3 = 1 OR NOT (TIMESTAMP '2024-01-01' + to_minutes(doc_id) < TIMESTAMP '2024-01-01 01:00:00')"""
)
def f02_kind_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers are exempt from the date filter."""
    early = F.col("at") < F.lit("2024-01-01 01:00:00").cast("timestamp")
    return items(spark, sf_dir).where((F.col("prio") == 1) | ~F.coalesce(early, F.lit(False))).select("doc_id")


@query(f"""WITH {_ITEMS_SQL} SELECT doc_id FROM items WHERE length(key) > 0 AND (doc_id % 5 <> 0 OR source <> 'src1')""")
def f03_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item needs a title, and a title or a link."""
    link = F.when((F.col("doc_id") % 5 == 0) & (F.col("source") == "src1"), F.lit("")).otherwise(F.concat(F.lit("l"), "doc_id"))
    rows = items(spark, sf_dir).withColumn("link", link)
    return rows.where((F.length(F.trim("key")) > 0) & (F.length(F.trim("link")) > 0)).select("doc_id")


@query(
    """SELECT user_id % 8 AS source, count(*) FILTER (event_type NOT IN ('view', 'click')) AS kept,
    count(*) FILTER (event_type IN ('view', 'click')) AS skipped FROM events GROUP BY 1"""
)
def f04_skip_announce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements are left out and counted."""
    skipped = F.col("event_type").isin("view", "click")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("source")).agg(
        F.count_if(~skipped).alias("kept"), F.count_if(skipped).alias("skipped")
    )


@query(
    """SELECT user_id AS source, count(*) AS n, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 's' || user_id || ': failed'
        WHEN 'signup' THEN 's' || user_id || ': served from its fallback' END AS gap FROM events GROUP BY 1"""
)
def f05_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a gap if its last scan failed (an error) or a fallback served it (a signup)."""
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("last")
    scans = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("n"), last)
    said = lambda what: F.concat(F.lit("s"), "source", F.lit(what))
    gap = F.when(F.col("last") == "error", said(": failed")).when(F.col("last") == "signup", said(": served from its fallback"))
    return scans.select("source", "n", gap.alias("gap"))


@query(
    """WITH e AS (SELECT event_id, nullif(user_id % 8, 3) AS source, ts AS dt FROM events),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC, event_id) AS rn, max(dt) OVER (PARTITION BY source) AS head FROM e),
    p AS (SELECT *, row_number() OVER (ORDER BY rn, head DESC, source NULLS LAST) AS pick FROM t)
    SELECT event_id, source, pick FROM p WHERE pick <= 150"""
)
def t01_null_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fair selection where an eighth of the rows has no source: they are a source of their own."""
    source = F.nullif(F.col("user_id") % 8, F.lit(3))
    found = table(spark, sf_dir, "events").select("event_id", source.alias("source"), F.col("ts").alias("at"))
    return topn.fair_top(found, BUDGET, "source", "at", "event_id").select("event_id", "source", "pick")


@query(
    """WITH e AS (SELECT event_id, nullif(user_id % 8, 3) AS source, nullif(event_type, 'view') AS kind, ts FROM events),
    seen AS (SELECT DISTINCT source, kind FROM e WHERE ts < TIMESTAMP '2024-01-01 06:00:00')
    SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.source IS NOT DISTINCT FROM e.source AND seen.kind IS NOT DISTINCT FROM e.kind)"""
)
def j01_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first six hours didn't have; either part of the key may be null."""
    kind = F.nullif("event_type", F.lit("view"))
    found = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id") % 8, F.lit(3)).alias("source"), kind.alias("kind"), "ts")
    seen = found.where(F.col("ts") < F.lit("2024-01-01 06:00:00").cast("timestamp_ntz")).select("source", "kind").distinct()
    return dedupe.unseen(found, seen, ["source", "kind"]).select("event_id")


@query(f"""WITH {_ITEMS_SQL} SELECT doc_id, key FROM items WHERE key NOT IN (SELECT key FROM items WHERE doc_id % 7 = 0)""")
def j01_anti_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(spark, sf_dir)
    return dedupe.unseen(found, found.where("doc_id % 7 = 0").select("key").distinct(), ["key"]).select("doc_id", "key")


@query(
    f"""WITH {_ITEMS_SQL}, {_STATE_SQL} SELECT doc_id, epoch(CASE WHEN s.source IS NOT NULL THEN s.cutoff ELSE TIMESTAMP '2024-01-01 02:00:00' END)::BIGINT AS cut
    FROM items i LEFT JOIN state s USING (source)"""
)
def j02_source_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cutoff that is there and empty holds; only without one the common cutoff does."""
    found = items(spark, sf_dir)
    common = F.lit("2024-01-01 02:00:00").cast("timestamp")
    dated = cutoff.with_cutoffs(found, source_state(found), common)
    return dated.select("doc_id", F.unix_timestamp("cutoff").alias("cut"))


@query(
    """WITH c AS (SELECT source, 'i' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS iid, doc_id FROM documents)
    SELECT c.source, c.iid, c.doc_id, l.quality FROM c JOIN labels l USING (doc_id)"""
)
def j09_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed's items get short ids, by which curated rows, that know nothing else, find them again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    numbered = topn.numbered_within(docs, ["source"], F.floor(F.col("doc_id") / 1000), [F.col("doc_id")], "n")
    numbered = numbered.select("source", F.concat(F.lit("i"), "n").alias("iid"), "doc_id")
    curated = table(spark, sf_dir, "labels").join(numbered, "doc_id").select("source", "iid", "quality")
    return numbered.join(curated, ["source", "iid"]).select("source", "iid", "doc_id", "quality")


@query(
    """WITH t AS (SELECT max(doc_id) + 1 AS n FROM documents), a AS (SELECT doc_id, j, (doc_id * 3 + j * 7919) % n AS ref FROM documents, t, (SELECT unnest([1, 2, 3]) AS j))
    SELECT a.doc_id, string_agg(d.source, ',' ORDER BY j) AS sources FROM a JOIN documents d ON d.doc_id = a.ref GROUP BY a.doc_id"""
)
def j10_array_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids in an array, of any document, are looked up one by one and gathered again in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    last = docs.agg((F.max("doc_id") + 1).alias("n"))  # one row
    places = F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda j: (F.col("doc_id") * 3 + j * 7919) % F.col("n"))
    refs = docs.crossJoin(F.broadcast(last)).select("doc_id", F.posexplode(places).alias("j", "ref"))
    met = refs.join(docs.select(F.col("doc_id").alias("ref"), "source"), "ref")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("j", "source"))), lambda x: x["source"])
    return met.groupBy("doc_id").agg(F.array_join(ordered, ",").alias("sources"))


@query(
    f"""WITH {_ITEMS_SQL}, ids AS (SELECT key, min(source) AS title FROM items WHERE prio = 0 GROUP BY key)
    SELECT doc_id, coalesce(title, source) AS title FROM items LEFT JOIN ids USING (key) WHERE prio = 1"""
)
def j11_title_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a fallback take the title that the primary source had for their key."""
    found = items(spark, sf_dir)
    titles = found.where("prio = 0").groupBy("key").agg(F.min("source").alias("title"))
    return found.where("prio = 1").join(titles, "key", "left").select("doc_id", F.coalesce("title", "source").alias("title"))


@query(
    f"""WITH {_ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, doc_id) AS n FROM items)
    SELECT doc_id, source, key FROM r WHERE n = 1"""
)
def u01_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_wins(items(spark, sf_dir), ["key"], ["source", "doc_id"]).select("doc_id", "source", "key")


@query(
    f"""WITH {_ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, dt DESC, doc_id) AS n FROM items)
    SELECT doc_id, key, prio FROM r WHERE n = 1 ORDER BY dt DESC, doc_id LIMIT 200"""
)
def u02_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first list that has a key wins; the newest rows are reported."""
    found = items(spark, sf_dir).withColumn("age", -F.unix_timestamp("at")).drop("prio")
    frames = [found.where(F.col("doc_id") % 3 == i) for i in range(3)]
    merged = dedupe.priority_union(frames, ["key"], ["age", "doc_id"])
    return merged.orderBy(F.desc("at"), "doc_id").limit(200).select("doc_id", "key", F.col("prio").cast("long").alias("prio"))


@query(
    f"""WITH {_ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC, doc_id) AS n FROM items)
    SELECT doc_id FROM items WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE n <= 2)"""
)
def u05_deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was collected and not recorded."""
    found = items(spark, sf_dir)
    recorded = topn.top_per_group(found, 2, ["source"], [F.desc("at"), F.col("doc_id")])
    return dedupe.unseen(found, recorded, ["doc_id"]).select("doc_id")


@query(
    f"""WITH {_ITEMS_SQL}, seen AS (SELECT key, min(doc_id) AS first_seen FROM items WHERE doc_id % 7 = 0 GROUP BY key),
    fresh AS (SELECT key, min(doc_id) AS first_seen FROM items GROUP BY key)
    SELECT * FROM seen UNION ALL SELECT * FROM fresh WHERE key NOT IN (SELECT key FROM seen)"""
)
def u08_seen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-only: a key that the state has keeps its row."""
    found = items(spark, sf_dir)
    first = lambda rows: rows.groupBy("key").agg(F.min("doc_id").alias("first_seen"))
    return dedupe.insert_only(first(found.where("doc_id % 7 = 0")), first(found), ["key"])


_FEED_SQL = "e AS (SELECT event_id, 's' || (user_id % 8) AS source, CASE WHEN event_id % 11 <> 0 THEN ts END AS dt FROM events)"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), F.col("user_id") % 8).alias("source"), at.alias("at"))


@query(
    f"""WITH {_FEED_SQL} SELECT source, count(*) AS raw, count(*) FILTER (dt >= TIMESTAMP '2024-01-20') AS in_window,
    count(*) FILTER (dt < TIMESTAMP '2024-01-20') AS older, count(*) FILTER (dt IS NULL) AS undated FROM e GROUP BY source"""
)
def a07_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-20").cast("timestamp")
    return feed(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("raw"), F.count_if(F.col("at") >= since).alias("in_window"),
        F.count_if(F.col("at") < since).alias("older"), F.count_if(F.col("at").isNull()).alias("undated"),
    )


@query(
    f"""WITH {_FEED_SQL}, r AS (SELECT *, dt IS NOT NULL AS dated, row_number() OVER (PARTITION BY source, dt IS NOT NULL ORDER BY dt DESC NULLS LAST, event_id) AS n
        FROM e WHERE dt IS NULL OR dt >= TIMESTAMP '2024-01-20'),
    k AS (SELECT *, count(*) FILTER (dated) OVER (PARTITION BY source) AS kept FROM r WHERE n <= 40)
    SELECT event_id, source FROM k WHERE dated OR n <= least(30, 40 - kept)"""
)
def w06_feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.lit("2024-01-20").cast("timestamp")
    return topn.feed_window(feed(spark, sf_dir), since, "source", "at", "event_id").select("event_id", "source")


@query(
    """SELECT user_id % 8 AS source, CASE WHEN count(*) = count(v) THEN min(v) END AS least
    FROM (SELECT user_id, CASE WHEN user_id % 8 <> 3 OR event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1"""
)
def a08_null_poison_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when((F.col("user_id") % 8 != 3) | (F.col("event_type") != "error"), F.col("value"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("source"), value.alias("v"))
    return rows.groupBy("source").agg(cutoff.null_poisoned_min("v").alias("least"))


_DEFERRED_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC NULLS LAST, event_id) AS n FROM e),
    d AS (SELECT source, min(dt) AS held FROM r WHERE n > 20 GROUP BY source)"""


def deferred(found: DataFrame) -> DataFrame:
    order = W.partitionBy("source").orderBy(F.desc_nulls_last("at"), "event_id")
    return found.withColumn("n", F.row_number().over(order)).where("n > 20")


@query(f"""WITH {_FEED_SQL}, {_DEFERRED_SQL} SELECT source, epoch_us(held) AS held FROM d""")
def a09_deferred_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deferred(feed(spark, sf_dir)).groupBy("source").agg(F.unix_micros(F.min("at")).alias("held"))


@query("""SELECT user_id % 8 AS source, bool_or(event_type = 'purchase' AND value > 200) AS any_ok FROM events GROUP BY 1""")
def a10_any_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("source")).agg(F.bool_or(ok).alias("any_ok"))


@query(
    """SELECT d.lang, count(*) AS sent, count(l.doc_id) AS reported, count(*) - count(l.doc_id) AS not_sent, sum(d.n_chars) AS chars
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang"""
)
def a11_curation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(
        F.count("*").alias("sent"), F.count("quality").alias("reported"),
        (F.count("*") - F.count("quality")).alias("not_sent"), F.sum("n_chars").alias("chars"),
    )


@query(
    f"""WITH {_FEED_SQL}, {_DEFERRED_SQL}, s AS (SELECT DISTINCT source FROM e)
    SELECT source, epoch_us(CASE WHEN source = 's3' THEN TIMESTAMP '2024-01-10' WHEN source = 's5' THEN TIMESTAMP '2024-01-12'
           ELSE least(coalesce(held, TIMESTAMP '{NOW}'), TIMESTAMP '{NOW}') END) AS cut
    FROM s LEFT JOIN d USING (source)"""
)
def r01_advance_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that succeeded move, no further than what they deferred; s3 and s5 failed: one keeps
    what it had, the other is pinned to the common cutoff."""
    found = feed(spark, sf_dir)
    state = spark.createDataFrame([("s3", True, "2024-01-10")], "source string, has_cutoff boolean, cutoff string")
    state = state.withColumn("cutoff", F.to_timestamp("cutoff"))
    runs = found.select("source").distinct().withColumn("ok", ~F.col("source").isin("s3", "s5"))
    common = F.lit("2024-01-12").cast("timestamp")
    moved = cutoff.advanced(state, runs, deferred(found), common, F.lit(NOW).cast("timestamp"))
    return moved.select("source", F.unix_micros("cutoff").alias("cut"))


@query(f"""WITH {_FEED_SQL} SELECT event_id FROM e WHERE dt >= TIMESTAMP '{NOW}' - INTERVAL 48 HOURS - INTERVAL 5 DAYS""")
def r02_lateness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection window: 48 hours of slack before a success five days ago."""
    now = F.lit(NOW).cast("timestamp")
    since = now - F.make_dt_interval(F.lit(5))
    return feed(spark, sf_dir).where(F.col("at") >= dates.window_start(since, now)).select("event_id")


@query(
    f"""WITH {_FEED_SQL}, {_DEFERRED_SQL} SELECT source, epoch_us(least(min(dt), TIMESTAMP '2024-01-15')) AS pinned
    FROM r WHERE n > 20 GROUP BY source"""
)
def r03_pin_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15").cast("timestamp")
    return deferred(feed(spark, sf_dir)).groupBy("source").agg(F.unix_micros(F.least(F.min("at"), now)).alias("pinned"))


@query(
    f"""WITH {_ITEMS_SQL}, firsts AS (SELECT key, min(doc_id) AS doc_id FROM items GROUP BY key) SELECT doc_id % 4 AS batch, count(*) AS n
    FROM firsts GROUP BY 1"""
)
def r04_stateful_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many new keys each batch of arrivals brings, in batch form."""
    fresh = dedupe.first_wins(items(spark, sf_dir), ["key"], ["doc_id"])
    return fresh.groupBy((F.col("doc_id") % 4).alias("batch")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_FEED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC NULLS LAST, event_id) AS rn, max(dt) OVER (PARTITION BY source) AS head FROM e),
    p AS (SELECT *, row_number() OVER (ORDER BY rn, head DESC NULLS LAST, source) AS pick FROM t)
    SELECT source, count(*) AS waiting, count(*) FILTER (pick <= {BUDGET}) AS admitted FROM p GROUP BY source"""
)
def r05_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source's backlog one trigger admits."""
    found = feed(spark, sf_dir)
    picked = topn.fair_top(found, BUDGET, "source", "at", "event_id").groupBy("source").agg(F.count("*").alias("admitted"))
    waiting = found.groupBy("source").agg(F.count("*").alias("waiting"))
    return waiting.join(picked, "source", "left").select("source", "waiting", F.coalesce("admitted", F.lit(0)).alias("admitted"))


@query(
    """WITH f AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN ts + INTERVAL 20 DAYS WHEN 1 THEN ts - INTERVAL 40 DAYS WHEN 2 THEN ts END AS since FROM events)
    SELECT event_id, epoch_us(greatest(coalesce(since - INTERVAL 48 HOURS, TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS), TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS)) AS start FROM f"""
)
def w01_window_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    days = lambda n: F.make_dt_interval(F.lit(n))
    kind = F.col("user_id") % 4
    since = F.when(kind == 0, ts + days(20)).when(kind == 1, ts - days(40)).when(kind == 2, ts)
    start = dates.window_start(since, F.lit("2024-01-31").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(start).alias("start"))


@query(
    f"""WITH {_FEED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dt DESC NULLS LAST, event_id) AS rn, max(dt) OVER (PARTITION BY source) AS head FROM e),
    p AS (SELECT *, row_number() OVER (ORDER BY rn, head DESC NULLS LAST, source) AS pick FROM t)
    SELECT event_id, source, pick FROM p WHERE pick <= {BUDGET}"""
)
def t01_fair_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.fair_top(feed(spark, sf_dir), BUDGET, "source", "at", "event_id").select("event_id", "source", "pick")


@query(
    f"""WITH {_ITEMS_SQL}, u AS (SELECT key, min(doc_id) AS doc_id FROM items GROUP BY key),
    r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM u JOIN items USING (doc_id))
    SELECT * FROM r WHERE rank <= 8"""
)
def t02_topk_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First come, eight per topic, each key once."""
    once = dedupe.first_wins(items(spark, sf_dir), ["key"], ["doc_id"])
    return topn.top_per_group(once, 8, ["source"], [F.col("doc_id")]).select("source", "doc_id", "rank")


@query(
    f"""WITH {_ITEMS_SQL}, b AS (SELECT *, doc_id % 5 AS batch, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS n FROM items),
    o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n, batch) AS copy FROM b WHERE n <= 10)
    SELECT doc_id, row_number() OVER (ORDER BY n, batch) AS rank FROM o WHERE copy = 1 ORDER BY n, batch LIMIT 3"""
)
def t03_round_robin_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches propose in turns; three different ones are picked."""
    batched = items(spark, sf_dir).withColumn("batch", F.col("doc_id") % 5)
    proposed = topn.top_per_group(batched, 10, ["batch"], [F.col("doc_id")], "n")
    once = dedupe.first_wins(proposed, ["key"], ["n", "batch"])
    return topn.top(once, 3, [F.col("n"), F.col("batch")]).select("doc_id", "rank")


@query(
    f"""WITH RECURSIVE {_ITEMS_SQL}, o AS (SELECT source, doc_id, least(n_chars, 9000) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM items),
    f AS (SELECT source, doc_id, n, 0 AS chunk, 1 AS held_n, size AS held FROM o WHERE n = 1 UNION ALL
      SELECT o.source, o.doc_id, o.n, CASE WHEN f.held_n >= 40 OR f.held + o.size > 16000 THEN f.chunk + 1 ELSE f.chunk END,
             CASE WHEN f.held_n >= 40 OR f.held + o.size > 16000 THEN 1 ELSE f.held_n + 1 END,
             CASE WHEN f.held_n >= 40 OR f.held + o.size > 16000 THEN o.size ELSE f.held + o.size END
      FROM f JOIN o ON o.source = f.source AND o.n = f.n + 1)
    SELECT source, doc_id, chunk FROM f"""
)
def g01_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 40 items and 16,000 characters per feed, in order."""
    sized = items(spark, sf_dir).select("source", "doc_id", F.least("n_chars", F.lit(9000)).alias("size"))
    return folds.chunked(sized, ["source"], "doc_id", "size", 40, 16_000).select("source", "doc_id", "chunk")


@query(
    f"""WITH {_ITEMS_SQL}, c AS (SELECT doc_id % 4 AS batch, doc_id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id % 4, doc_id) AS n FROM items)
    SELECT batch, doc_id, key FROM c WHERE n = 1"""
)
def g02_claim_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first batch that reports an item has it."""
    claimed = dedupe.first_wins(items(spark, sf_dir).withColumn("batch", F.col("doc_id") % 4), ["key"], ["batch", "doc_id"])
    return claimed.select("batch", "doc_id", "key")


@query(
    """WITH b AS (SELECT d.doc_id, d.doc_id // 40 AS batch, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
    f AS (SELECT batch, bool_or(doc_id % 97 = 0) AS failed FROM b GROUP BY 1)
    SELECT doc_id, CASE WHEN NOT failed AND quality IS NOT NULL THEN CASE WHEN toxic = 1 THEN 3 WHEN quality = 1 THEN 1 ELSE 2 END END::INT AS tier,
           NOT failed AND quality IS NOT NULL AS curated, CASE WHEN failed THEN 'ValueError: no reply' END AS problem FROM b JOIN f USING (batch)"""
)
def d01_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curator is any function from a batch of items to tiers; where it fails, its batch is listed as it is."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.floor(F.col("doc_id") / 40).alias("batch"), "quality", "toxic")

    def by_label(batch):
        if any(r["doc_id"] % 97 == 0 for r in batch):
            raise ValueError("no reply")
        return [(r["doc_id"], 3 if r["toxic"] == 1 else 1 if r["quality"] == 1 else 2) for r in batch if r["quality"] is not None]

    return curators.curated(rows, ["batch"], ["doc_id"], "doc_id", by_label, "tier int")


@query(
    """SELECT source, doc_id AS latest, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1"""
)
def s36_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run of each watch, as one aggregate."""
    newest = F.max_by(F.struct("doc_id", "n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").groupBy("source").agg(newest.alias("r")).select(
        "source", F.col("r.doc_id").alias("latest"), F.col("r.n_chars").alias("n_chars")
    )


@query(
    """WITH i AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
    t AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n FROM i)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'hit' WHEN n <= 40 THEN 'fetch' ELSE 'pending' END AS action FROM t WHERE n <= 60"""
)
def s11_index_then_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest of an index; what the cache has is a hit, a bounded number is fetched, the rest waits."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    chosen = topn.top(recent, 60, [F.desc("o_orderdate"), F.col("o_orderkey")], "n")
    cache = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select("o_orderkey", "o_orderdate", F.lit(True).alias("hit"))
    met = chosen.join(cache, ["o_orderkey", "o_orderdate"], "left")
    action = F.when(F.col("hit"), "hit").when(F.col("n") <= 40, "fetch").otherwise("pending")
    return met.select("o_orderkey", action.alias("action"))


@query(
    """WITH p AS (SELECT user_id, event_id, 0 AS prio FROM events WHERE event_type <> 'error'), f AS (SELECT user_id, event_id, 1 AS prio FROM events WHERE event_type = 'error'),
    u AS (SELECT * FROM p UNION ALL SELECT * FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prio, event_id) AS n FROM u)
    SELECT user_id, event_id, prio FROM r WHERE n = 1"""
)
def s14_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fallback serves what the primary lacks."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    frames = [events.where("event_type <> 'error'"), events.where("event_type = 'error'")]
    return dedupe.priority_union(frames, ["user_id"], ["event_id"]).select("user_id", "event_id", "prio")


@query(
    """WITH f AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
        - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id, bad, island ORDER BY event_id) AS streak FROM f)
    SELECT user_id, event_id, streak, least(1440, 60 * 2 ** (streak - 1))::BIGINT AS minutes FROM s WHERE bad"""
)
def s04_block_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a source is left alone after each failure in a row: doubling, bounded."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    bad = F.col("event_type") == "error"
    good_before = F.sum((~bad).cast("int")).over(order)
    marked = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", bad.alias("bad"), good_before.alias("island")).where("bad")
    streak = F.row_number().over(W.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    minutes = F.least(F.lit(1440), (F.lit(60) * F.pow(F.lit(2), streak - 1))).cast("long")
    return marked.select("user_id", "event_id", streak.alias("streak"), minutes.alias("minutes"))


@query(
    f"""WITH {_ITEMS_SQL} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'CVE-' || doc_id WHEN 1 THEN 'arxiv:' || doc_id ELSE key END AS identity,
    CASE source WHEN 'src0' THEN 'vendor' WHEN 'src1' THEN 'press' ELSE 'other' END AS category FROM items"""
)
def x33_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What identifies an item by kind, and the category its source is in."""
    own = F.col("doc_id").cast("string")
    identity = F.when(F.col("prio") == 0, F.concat(F.lit("CVE-"), own)).when(F.col("prio") == 1, F.concat(F.lit("arxiv:"), own)).otherwise(F.col("key"))
    known = F.create_map(F.lit("src0"), F.lit("vendor"), F.lit("src1"), F.lit("press"))
    category = F.coalesce(F.try_element_at(known, F.col("source")), F.lit("other"))
    return items(spark, sf_dir).select("doc_id", identity.alias("identity"), category.alias("category"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(said, '(?i)^(tier )?[123]$') THEN regexp_extract(said, '([123])$', 1)::INT ELSE 2 END AS tier,
    CASE WHEN regexp_matches(said, '^[123]$') THEN '' WHEN regexp_matches(said, '(?i)^tier [123]$') THEN 'tier read from text' ELSE 'tier set to 2' END AS notes
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'Tier 3' ELSE 'high' END AS said FROM documents)"""
)
def v03_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant reading of a curator's reply, with a note on each change."""
    said = F.element_at(F.array(F.lit("1"), F.lit("Tier 3"), F.lit("high")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"))
    number = F.regexp_extract("said", "(?i)^(?:tier )?([123])$", 1).try_cast("int")
    notes = text.flags(
        (("tier read from text", number.isNotNull() & F.col("said").rlike("(?i)^tier")), ("tier set to 2", number.isNull()))
    )
    return rows.select("doc_id", F.coalesce(number, F.lit(2)).alias("tier"), F.array_join(notes, "; ").alias("notes"))
