"""Content scans, configuration text and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.functions import scalars, text
from sparkreef.operators import folds, reconcile, rules
from sparkreef.queries import query, table
from sparkreef.sources import sinks

_LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.posexplode(F.split("text", "\n")).alias("at", "line")
    return table(spark, sf_dir, "documents").select("doc_id", numbered).select("doc_id", "line", (F.col("at") + 1).alias("pos"))


@query(
    rf"""WITH {_LINES_SQL}, h AS (SELECT doc_id, pos, concat_ws(',', CASE WHEN line LIKE '%@%' THEN 'fixed:@' END, CASE WHEN regexp_matches(line, '(?i)\b(license)\b') THEN 'word:license' END,
    CASE WHEN regexp_matches(line, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AND NOT regexp_matches(line, '10\.0\.') THEN 'shape:0' END) AS hits FROM lines) SELECT * FROM h WHERE hits <> ''"""
)
def f12_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed strings, whole words and shapes, a line at a time."""
    found = rules.scanned(lines(spark, sf_dir), "line", ("@",), ("license",), (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",), (r"10\.0\.",))
    return found.select("doc_id", "pos", F.array_join("hits", ",").alias("hits"))


@query(
    """WITH a AS (SELECT doc_id, list_slice(string_split(text, ' '), 1, 4) AS argv FROM documents) SELECT doc_id FROM a WHERE len(list_filter(argv, lambda x: ends_with(x, 'er') OR ends_with(x, 'on'))) > 0"""
)
def f19_process_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of the first four arguments ends in either of two names."""
    argv = F.slice(F.split("text", " "), 1, 4)
    hit = F.exists(argv, lambda a: a.endswith("er") | a.endswith("on"))
    return table(spark, sf_dir, "documents").where(hit).select("doc_id")


@query(
    f"""WITH {_LINES_SQL}, k AS (SELECT doc_id, pos, regexp_extract(line, '^(#? ?)([A-Za-z]+)', 2) AS key FROM lines), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k WHERE key <> '')
    SELECT doc_id, pos, key FROM r WHERE n = 1"""
)
def s29_first_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an environment file, each at its first line."""
    keyed = lines(spark, sf_dir).select("doc_id", "pos", F.regexp_extract("line", "^(#? ?)([A-Za-z]+)", 2).alias("key")).where("key <> ''")
    return keyed.groupBy("doc_id", "key").agg(F.min("pos").alias("pos"))


_TAGGED = "CASE WHEN pos % 4 = 1 THEN 'v' || pos END"


@query(
    f"""WITH {_LINES_SQL}, t AS (SELECT doc_id, pos, {_TAGGED} AS tag FROM lines),
    w AS (SELECT doc_id, pos, coalesce(lag(tag, 1) OVER w, lag(tag, 2) OVER w, lag(tag, 3) OVER w) AS tag FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT * FROM w WHERE tag IS NOT NULL"""
)
def w13_line_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag in one of the three lines before."""
    order = W.partitionBy("doc_id").orderBy("pos")
    tag = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("v"), "pos"))
    rows = lines(spark, sf_dir).select("doc_id", "pos", tag.alias("tag"))
    return rows.withColumn("tag", F.coalesce(*(F.lag("tag", i).over(order) for i in (1, 2, 3)))).where("tag is not null")


@query(
    f"""WITH {_LINES_SQL}, i AS (SELECT doc_id, pos, regexp_extract(line, '^([A-Za-z]+)', 1) AS image FROM lines WHERE line <> '')
    SELECT image, count(DISTINCT doc_id) AS n_files, min(doc_id) AS first FROM i WHERE image <> '' GROUP BY image"""
)
def s31_image_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("doc_id", F.regexp_extract("line", "^([A-Za-z]+)", 1).alias("image")).where("image <> ''")
    return found.groupBy("image").agg(F.count_distinct("doc_id").alias("n_files"), F.min("doc_id").alias("first"))


@query("""SELECT lang AS ref, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM documents GROUP BY lang""")
def j19_distinct_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References collapsed, so that each is looked up once."""
    merged = F.array_join(F.array_sort(F.collect_set("source")), "; ")
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("ref")).agg(merged.alias("sources"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM documents), f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL)
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id""")
def a25_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order in which they come."""
    words = F.array_distinct(F.split("text", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words, " ").alias("words"))


@query("""WITH h AS (SELECT source, sha256(text) || '  ' || doc_id AS entry FROM documents WHERE lang <> 'de'),
    b AS (SELECT source, substr(entry, 1, 4) AS branch, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS digest FROM h GROUP BY ALL)
    SELECT source, sha256(string_agg(branch || ' ' || digest, chr(10) ORDER BY branch)) AS digest FROM b GROUP BY source""")
def a30_tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash that doesn't depend on the order of the files: of the hashes of 65,536 branches, each
    the hash of its sorted entries, so that no task holds a whole tree's list."""
    entry = F.concat(F.sha2("text", 256), F.lit("  "), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").where("lang <> 'de'").select("source", entry.alias("entry"))
    listed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256).alias("digest")
    branches = rows.groupBy("source", F.substring("entry", 1, 4).alias("branch")).agg(listed("entry"))
    return branches.groupBy("source").agg(listed(F.concat_ws(" ", "branch", "digest")))


@query("""SELECT doc_id, 'file' AS mode, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents""")
def s39_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("file").alias("mode"), F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size")
    )


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN turn > 0 AND (turn * 7 + conv_id) % 5 = 3 THEN 'system' ELSE role END AS role, text FROM conversations),
    l AS (SELECT *, min(CASE WHEN role <> 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first_other FROM c),
    m AS (SELECT *, role = 'system' AND turn > coalesce(first_other, 1000000) AS late FROM l),
    r AS (SELECT *, sum((late AND NOT coalesce(plate, false))::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(late) OVER (PARTITION BY conv_id ORDER BY turn) AS plate FROM m)),
    g AS (SELECT conv_id, run, min(turn) AS first, max(turn) AS last, '[note]' || string_agg(text, chr(10) || chr(10) ORDER BY turn) || '[/note]' AS text FROM r WHERE late GROUP BY 1, 2),
    t AS (SELECT g.*, (SELECT arg_max((r.turn, r.role), r.turn) FROM r WHERE r.conv_id = g.conv_id AND NOT r.late AND r.turn < g.first) AS b,
        (SELECT min(r.turn) FROM r WHERE r.conv_id = g.conv_id AND r.role = 'user' AND r.turn > g.last) AS nu FROM g),
    n AS (SELECT conv_id, CASE WHEN b[2] = 'user' THEN b[1] ELSE coalesce(nu, first) END AS turn, CASE WHEN b[2] = 'user' THEN 1 ELSE -1 END AS side, first AS pos, text FROM t),
    p AS (SELECT conv_id, turn, role, 0 AS side, 0 AS pos, text FROM r WHERE NOT late UNION ALL SELECT conv_id, turn, NULL, side, pos, text FROM n)
    SELECT conv_id, turn, coalesce(max(role), 'user') AS role, sha256(string_agg(text, chr(10) || chr(10) ORDER BY side, pos)) AS digest FROM p GROUP BY 1, 2""")
def g05_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with system turns in the middle, rewritten so that only leading ones are left."""
    late = (F.col("turn") > 0) & ((F.col("turn") * 7 + F.col("conv_id")) % 5 == 3)
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when(late, "system").otherwise(F.col("role")))
    out = folds.normalized_turns(turns, "conv_id", "turn", "role", "text", ("[note]", "[/note]"))
    return out.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@query("""WITH s AS (SELECT doc_id, string_split(source || ';' || lang, ';') AS slots FROM documents) SELECT doc_id, concat_ws(';', slots[1], CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE slots[2] END, 'PENDING') AS slots FROM s""")
def g12_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of fixed slots: one is set, what is missing becomes a placeholder."""
    slots = F.split(F.concat_ws(";", "source", "lang"), ";")
    padded = F.slice(F.concat(slots, F.array_repeat(F.lit("PENDING"), 3)), 1, 3)
    merged = F.transform(padded, lambda x, i: F.when((i == 1) & (F.col("doc_id") % 3 == 0), "new").otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(merged, ";").alias("slots"))


@query(f"""WITH {_LINES_SQL} SELECT '-' AS side, line FROM (SELECT line FROM lines EXCEPT ALL SELECT CASE WHEN doc_id % 20 = 0 THEN line || '!' ELSE line END FROM lines WHERE doc_id % 7 <> 3)
    UNION ALL SELECT '+', line FROM (SELECT CASE WHEN doc_id % 20 = 0 THEN line || '!' ELSE line END AS line FROM lines WHERE doc_id % 7 <> 3 EXCEPT ALL SELECT line FROM lines)""")
def g13_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that one rendering of all documents has and the other lacks, as often, both ways."""
    found = lines(spark, sf_dir)
    again = F.when(F.col("doc_id") % 20 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line")
    return reconcile.line_diff(found.select("line"), found.where("doc_id % 7 <> 3").select(again), "line")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 9 = 0 THEN 'refused' END AS refused, least(coalesce(CASE WHEN turn % 2 = 0 THEN turn * 3000 + 1 END, 4096), 8192) AS "limit" FROM conversations)
    SELECT conv_id, turn, role, refused, "limit", CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'tools' END AS tools FROM t""")
def d03_request_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guard, cap and strip, in this order, as transforms of one frame."""

    def guard(df: DataFrame) -> DataFrame:
        return df.withColumn("refused", F.when(F.col("conv_id") % 9 == 0, "refused"))

    def cap(df: DataFrame) -> DataFrame:
        asked = F.when(F.col("turn") % 2 == 0, F.col("turn") * 3000 + 1)
        return df.withColumn("limit", scalars.cap_output(asked, 4096, 8192)["limit"])

    def strip(df: DataFrame) -> DataFrame:
        fields = F.create_map(F.lit("tools"), F.lit("tools"))
        allowed = F.map_filter(fields, lambda k, _: ~((F.col("conv_id") % 4 == 0) & (k == "tools")))
        return df.withColumn("tools", F.array_join(F.map_values(allowed), ","))

    hooked = table(spark, sf_dir, "conversations").transform(guard).transform(cap).transform(strip)
    return hooked.select("conv_id", "turn", "role", "refused", "limit", "tools")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'k' END AS fields FROM events""")
def d04_strip_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", F.lit("map<string,string>"))
    kept = F.map_filter(parsed, lambda k, _: ~((F.col("user_id") % 3 == 0) & (k == "k")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("fields"))


@query("""SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant') THEN '$.role' WHEN turn > 4 THEN '$.turn' WHEN length(text) > 300 THEN '$.text' END AS path FROM conversations""")
def v02_first_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path that offends."""
    tests = (("$.role", ~F.col("role").isin("user", "assistant")), ("$.turn", F.col("turn") > 4), ("$.text", F.length("text") > 300))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(*(F.when(t, p) for p, t in tests)).alias("path"))


@query("""SELECT lang, 0 AS place, '# ' || lang AS line FROM documents WHERE n_chars > 5000 GROUP BY lang UNION ALL
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id), '- ' || doc_id || ': ' || source FROM documents WHERE n_chars > 5000""")
def k08_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "documents").where("n_chars > 5000")
    line = F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(": "), "source")
    return sinks.report(long, "lang", ["doc_id"], line, F.concat(F.lit("# "), "lang"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'CVE-2024-' || (1000 + doc_id) WHEN 1 THEN 'GHSA-ABCD-1234-EFGH' WHEN 2 THEN 'WID-SEC-2024-' || doc_id END AS advisory,
    CASE doc_id % 4 WHEN 0 THEN '2401.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') WHEN 1 THEN '2402.00001' END AS arxiv FROM documents""")
def x05_x06_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisory and paper ids, found in titles and links."""
    own, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    title = F.when(n == 0, F.concat(F.lit("About cve-2024-"), (F.col("doc_id") + 1000).cast("string"), F.lit(": x"))).when(n == 1, "see ghsa-abcd-1234-efgh").when(
        n == 2, F.concat(F.lit("[WID-SEC-2024-"), own, F.lit("] y"))
    )
    link = F.when(n == 0, F.concat(F.lit("http://arxiv.org/abs/2401."), F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "0"), F.lit("v2"))).otherwise(F.lit(""))
    oai = F.when(n == 1, "oai:arXiv.org:2402.00001").otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.advisory_id(title).alias("advisory"), text.arxiv_id(link, oai).alias("arxiv"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'CVE-2024-1234' WHEN doc_id % 5 = 1 THEN 'http://x/' || doc_id ELSE 'title of ' || source END AS key FROM documents""")
def x07_item_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 5
    title = F.when(n == 0, "CVE-2024-1234 found").otherwise(F.concat(F.lit("<b>Title</b> of  "), "source"))
    link = F.when(n == 1, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).otherwise(F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", text.item_key(title, link).alias("key"))


@query(r"""SELECT doc_id, regexp_replace(substr(text, 1, 60), '[^ -~]', '.', 'g') AS snippet FROM documents""")
def x09_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One printable line of what a body begins with."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.substring("text", 1, 60), "[^ -~]", ".").alias("snippet"))


@query(r"""SELECT page_id, replace(replace(replace(url, '\', '\\'), '"', '\"'), chr(10), '\n') AS label FROM pages""")
def x11_label_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.replace(F.replace(F.col("url"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(value, F.lit("\n"), F.lit("\\n")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%gear%' THEN 'projector' WHEN p_name LIKE '%ring%' THEN 'draft' ELSE 'weights' END AS role FROM part""")
def x18_file_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = text.first_match(F.col("p_name"), (("gear", "projector"), ("ring", "draft")), "weights")
    return table(spark, sf_dir, "part").select("p_partkey", role.alias("role"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 100 WHEN 1 THEN 90000 WHEN 2 THEN NULL ELSE -5 END AS n FROM events) SELECT event_id, CASE WHEN n > 0 AND n <= 8192 THEN n ELSE 8192 END AS n FROM m""")
def x46_clamp_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Either field of a body, if it is within the cap; else the cap."""
    k = F.col("event_id") % 4
    body = F.when(k == 0, '{"max_tokens":100}').when(k == 1, '{"max_completion_tokens":90000}').when(k == 2, "{}").otherwise('{"max_tokens":-5}')
    n = F.coalesce(F.get_json_object(body, "$.max_completion_tokens"), F.get_json_object(body, "$.max_tokens")).try_cast("long")
    held = F.when((n > 0) & (n <= 8192), n).otherwise(8192)
    return table(spark, sf_dir, "events").select("event_id", held.alias("n"))


@query("""SELECT p_partkey, (p_size::BIGINT * 2 * 131072 * 2 * 128 * 34 // 32)::BIGINT AS kv_bytes, list_sum(list_transform(range(p_size), lambda i: CASE WHEN i % 6 = 5 THEN 131072 ELSE 1024 END))::BIGINT AS cells FROM part""")
def x35_cache_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache bytes by layers, heads and block format; every sixth layer sees the whole context."""
    layers = F.col("p_size").cast("long")
    cells = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.when(i % 6 == 5, 131_072).otherwise(1024).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(layers * 2 * 131_072 * 2 * 128 * 34 / 32).alias("kv_bytes"), cells.alias("cells"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(6), lambda i: CASE WHEN i < p_size % 4 THEN i ELSE 9 END), ',') AS per_layer FROM part""")
def x38_per_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per layer, padded or cut to as many as there are."""
    given = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("p_size") % 4)
    padded = F.slice(F.concat(given, F.array_repeat(F.lit(9), 6)), 1, 6)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("per_layer"))
