"""Scalar functions over documents, pages, events and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.functions import dates, scalars, text
from sparkreef.queries import query, table

ROUTES = ("local", "openai", "https:/", "http:/")
MACROS = {"base": "root ${host}", "host": "h1"}
LICENSES = (("(?i)by-nc|non-?commercial", "restricted"), ("(?i)general public license|gpl", "copyleft"), ("(?i)apache|mit license|bsd", "permissive"))


@query(r"""SELECT doc_id, substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS key
           FROM documents""")
def x01_norm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_key(F.col("text")).alias("key"))


@query(r"""SELECT page_id, length(t) AS n_chars, sha256(t) AS digest FROM (SELECT page_id,
           trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def x02_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).alias("n_chars"), text.short_digest(clean).alias("digest"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 260 THEN text ELSE rtrim(substr(text, 1, 259)) || '…' END AS cut FROM documents""")
def x03_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.ellipsis(F.col("text"), 260).alias("cut"))


@query("""SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
          '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS digest FROM pages""")
def x04_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.short_digest(text.unescape(F.col("html"))).alias("digest"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS place FROM pages""")
def x08_host_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.host_and_path(F.col("url")).alias("place"))


@query(r"""SELECT doc_id, sha256(regexp_replace(text, '([\\`*_\[\]<>|])', '\\\1', 'g')) AS digest,
           replace(replace(substr(text, 1, 80), '|', '\|'), chr(10), ' ') AS cell FROM documents""")
def x10_markdown_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.short_digest(text.markdown_safe(F.col("text"))).alias("digest"),
        text.table_cell(F.substring("text", 1, 80)).alias("cell"),
    )


@query(r"""SELECT doc_id, substr(regexp_replace(text, '[^0-9A-Za-z_.@+ -]', '', 'g'), 1, 96) AS value FROM documents""")
def x13_header_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.header_value(F.col("text")).alias("value"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}', '<ip>', 'g'),
           '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '<mail>', 'g')) AS digest FROM documents""")
def x14_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = ((r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "<ip>"), (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "<mail>"))
    return table(spark, sf_dir, "documents").select("doc_id", text.short_digest(text.scrub(F.col("text"), masks)).alias("digest"))


@query(r"""SELECT page_id, trim(regexp_replace(lower(trim(url)), '^(?:(?:local|openai|https:/|http:/)/\s*)+', '')) AS name FROM pages""")
def x15_route_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_route(F.col("url"), ROUTES).alias("name"))


@query(r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
             || CASE WHEN page_id % 3 = 0 THEN ':v1' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '@sha256:ab' ELSE '' END AS ref FROM pages),
           s AS (SELECT page_id, regexp_replace(ref, '@.*$', '') AS bare, nullif(regexp_extract(ref, '@(.+)$', 1), '') AS digest FROM r),
           t AS (SELECT page_id, digest, nullif(regexp_extract(bare, ':([^:/]+)$', 1), '') AS tag, regexp_replace(bare, ':[^:/]+$', '') AS path FROM s)
           SELECT page_id, regexp_extract(path, '^([^/]+)/', 1) AS registry, regexp_replace(path, '^[^/]+/', '') AS repository,
                  CASE WHEN tag IS NULL AND digest IS NULL THEN 'latest' ELSE tag END AS tag, digest FROM t""")
def x16_image_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    tag = F.when(F.col("page_id") % 3 == 0, ":v1").otherwise("")
    digest = F.when(F.col("page_id") % 5 == 0, "@sha256:ab").otherwise("")
    ref = text.image_reference(F.concat(bare, tag, digest))
    return table(spark, sf_dir, "pages").select("page_id", ref.alias("ref")).select("page_id", "ref.*")


@query(r"""WITH l AS (SELECT doc_id, regexp_extract(text, '[^\n]*[Ll]icen[sc]e[^\n]*') AS line FROM documents),
    f AS (SELECT doc_id, line, CASE WHEN regexp_matches(line, '(?i)by-nc|non-?commercial') THEN 'restricted' WHEN regexp_matches(line, '(?i)general public license|gpl') THEN 'copyleft'
          WHEN regexp_matches(line, '(?i)apache|mit license|bsd') THEN 'permissive' WHEN line = '' THEN 'none' ELSE 'unknown' END AS license FROM l)
    SELECT doc_id, license, CASE WHEN license IN ('permissive', 'copyleft') THEN 'usable' WHEN license = 'none' THEN 'unmarked' ELSE 'review' END AS class FROM f""")
def x17_license_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that a document's first license line names, by a ladder of patterns, and its class."""
    line = F.coalesce(F.get(F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll]icen[sc]e")), F.lit(0)), F.lit(""))
    found = text.first_match(line, (*LICENSES, ("^$", "none")), "unknown")
    kind = text.first_match(F.col("license"), (("permissive|copyleft", "usable"), ("none", "unmarked")), "review")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("license")).withColumn("class", kind)


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) > 4000 THEN 'long' END,
             CASE WHEN regexp_matches(text, '[0-9]{5,}') THEN 'number' END, CASE WHEN text LIKE '%@%' THEN 'address' END,
             CASE WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'marks' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""")
def x19_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rules = (("long", F.length(t) > 4000), ("number", t.rlike("[0-9]{5,}")), ("address", t.contains("@")), ("marks", t.rlike("[#*$%&]{3}")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.flags(rules), ",").alias("flags"))


@query("""SELECT doc_id, sha256(text) AS full_hex, substr(sha256(text), 1, 24) AS part, substr(sha256(text), 1, 12) AS short FROM documents""")
def x20_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.short_digest(t).alias("full_hex"), text.short_digest(t, 24).alias("part"), text.short_digest(t, 12).alias("short")
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events""")
def x22_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    forms = [
        F.concat(F.element_at(F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), F.weekday(at) + 1), F.date_format(at, "', 'dd MMM yyyy HH:mm:ss +0000")),
        F.date_format(at, "d MMM yyyy HH:mm:ss 'GMT'"),
        dates.iso_z(at),
        F.lit("not a date"),
    ]
    written = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(dates.parse_date(written)).alias("seconds"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS run_id FROM events""")
def x23_iso_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", dates.iso_z(at).alias("iso"), dates.run_id(at).alias("run_id"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch(date_trunc('day', ts))::BIGINT END AS seconds FROM events""")
def x24_checked_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    written = F.when(F.col("event_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy/MM/dd"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(dates.checked_timestamp(written)).alias("seconds"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h'
                 ELSE (s // 86400) || 'd' END AS age FROM (SELECT event_id, (event_id * 37)::BIGINT AS s FROM events)""")
def x25_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", dates.age(F.col("event_id") * 37).alias("age"))


@query("""SELECT doc_id, 'run root h1 ' || source || ' ${none}' AS command FROM documents""")
def x26_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("run ${base} "), "source", F.lit(" ${none}"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.expand_macros(raw, MACROS).alias("command"))


@query("""SELECT event_id, least(50.0, greatest(5.0, CASE WHEN event_id % 7 = 0 THEN 20.0 ELSE value END)) AS held,
                 (event_id + 31) // 32 * 32 AS padded FROM events""")
def x28_clamp_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "junk").otherwise("NaN")).otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.clamped(written, 5, 50, 20).alias("held"), scalars.padded(F.col("event_id"), 32).alias("padded")
    )


@query("""WITH a AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id END AS asked FROM events)
          SELECT event_id, nullif(asked, 0) AS asked, least(coalesce(nullif(asked, 0), 4096), 8192) AS held,
                 CASE WHEN nullif(asked, 0) IS NULL THEN 'default' WHEN asked > 8192 THEN 'capped' ELSE 'kept' END AS change FROM a""")
def x32_cap_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    forms = (n, F.concat(n, F.lit(".0")), F.concat(F.lit('"'), n, F.lit('"')), F.lit("true"), F.concat(F.lit("-"), n), F.concat(n, F.lit(".5")))
    written = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", scalars.as_limit(written).alias("asked"))
        .withColumn("cap", scalars.cap_output(F.col("asked"), 4096, 8192))
        .select("event_id", "asked", F.col("cap.limit").alias("held"), F.col("cap.change").alias("change"))
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_quantity * 32)::BIGINT % 256 = 0 THEN (l_quantity * 32)::BIGINT // 256 * 144 END AS n_bytes
          FROM lineitem""")
def x34_tensor_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = (F.col("l_quantity") * 32).cast("long")
    size = scalars.tensor_bytes(elements, F.lit(256), F.lit(144))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", size.alias("n_bytes"))


@query("""SELECT p_partkey, CASE WHEN p_size * 2.5 > 80 THEN 'A' WHEN p_size * 2.5 > 30 THEN 'B' WHEN p_size * 2.5 > 10 THEN 'C' ELSE 'D' END AS class,
                 least(40, greatest(1, floor((p_size * 300 - 512) / 240.0)))::INT AS chunk FROM part""")
def x36_speed_and_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        scalars.speed_class(F.col("p_size") * 2.5).alias("class"),
        scalars.chunk_limit(F.col("p_size") * 300).alias("chunk"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k')::INT END AS k FROM events""")
def x40_outermost_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = (F.col("props"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here: "), "props", F.lit(" done")), F.lit("none"))
    reply = F.element_at(F.array(*forms), (F.col("event_id") % 4 + 1).cast("int"))
    found = scalars.outermost_object(reply)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"))


@query("""WITH v AS (SELECT p_partkey, p_size AS a, p_partkey % 10 AS b, p_partkey % 7 AS c, p_partkey % 11 = 0 AS rc, p_partkey % 13 = 0 AS bad FROM part)
          SELECT p_partkey, CASE WHEN bad THEN NULL
            ELSE ((a, b, c, CASE WHEN rc THEN 0 ELSE 1 END) >= (10, 0, 0, 1) AND (a, b, c, CASE WHEN rc THEN 0 ELSE 1 END) < (20, 5, 0, 1))
              OR (a, b, c, CASE WHEN rc THEN 0 ELSE 1 END) >= (40, 0, 0, 1) END AS affected FROM v""")
def x42_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    written = F.concat_ws(".", "p_size", key % 10, key % 7)
    written = F.when(key % 13 == 0, "unknown").when(key % 11 == 0, F.concat(written, F.lit("rc1"))).otherwise(F.concat(F.lit("v"), written))
    ranges = ((((">="), "10.0"), ("<", "20.5.0")), ((">=", "40"),))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.in_range(scalars.version(written), ranges).alias("affected"))


@query("""SELECT doc_id, n_chars::VARCHAR AS ctx, source AS name, NULL::VARCHAR AS other FROM documents""")
def x43_command_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.concat(F.lit("serve -c "), F.col("n_chars").cast("string"), F.lit(" --name="), "source")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        scalars.command_flag(command, "-c").alias("ctx"),
        scalars.command_flag(command, "--name").alias("name"),
        scalars.command_flag(command, "--other").alias("other"),
    )


@query(r"""SELECT page_id, CASE WHEN url LIKE '%example.net%' THEN 'inner' ELSE substr(regexp_replace(url, '^https?://', ''), 1, 40) END AS name FROM pages""")
def x45_probe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("url").contains("example.net"), "inner")
    name = F.coalesce(known, F.substring(F.regexp_replace("url", "^https?://", ""), 1, 40))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
