"""Runs: batches whose replies overflow, claims, constraints, limiters and polls that go on in order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreef.operators import curation, folds, topn
from sparkreef.operators.lineage import shared_folder
from sparkreef.queries import query, table
from sparkreef.sources import manifests
from sparkreef.streaming import admission, digest, progress

BATCH = 40
CEILING = 60_000

_BATCH_SQL = f"i AS (SELECT source, n // {BATCH} AS batch, doc_id, n_chars, n % {BATCH} + 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents))"


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each source in batches of BATCH, by their order."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rows = topn.numbered_within(docs, ["source"], F.floor(F.col("doc_id") / 1000), [F.col("doc_id")], "n").withColumn("n", F.col("n") - 1)
    return rows.select("source", F.floor(F.col("n") / BATCH).alias("batch"), "doc_id", "n_chars", (F.col("n") % BATCH + 1).alias("place"))


@query(
    f"""WITH RECURSIVE {_BATCH_SQL}, u AS (SELECT *, sum(n_chars) OVER (PARTITION BY source, batch ORDER BY place) AS upto FROM i),
    p AS (SELECT source, batch, '' AS part, 0 AS lo, max(place)::INT AS hi, sum(n_chars)::BIGINT AS held FROM i GROUP BY source, batch
      UNION ALL SELECT p.source, p.batch, p.part || h.half,
        CASE WHEN h.half = 0 THEN p.lo ELSE p.lo + (p.hi - p.lo) // 2 END, CASE WHEN h.half = 0 THEN p.lo + (p.hi - p.lo) // 2 ELSE p.hi END,
        CASE WHEN h.half = 0 THEN m.upto - coalesce(l.upto, 0) ELSE e.upto - m.upto END::BIGINT
      FROM p JOIN (VALUES (0), (1)) h(half) ON p.held > {CEILING} AND p.hi - p.lo > 1 AND length(p.part) < 3
      JOIN u m ON m.source = p.source AND m.batch = p.batch AND m.place = p.lo + (p.hi - p.lo) // 2
      JOIN u e ON e.source = p.source AND e.batch = p.batch AND e.place = p.hi
      LEFT JOIN u l ON l.source = p.source AND l.batch = p.batch AND l.place = p.lo),
    d AS (SELECT * FROM p WHERE NOT (held > {CEILING} AND hi - lo > 1 AND length(part) < 3)),
    f AS (SELECT d.*, (SELECT min(doc_id) FROM i WHERE i.source = d.source AND i.batch = d.batch AND i.place > d.lo AND i.place <= d.hi) AS first FROM d)
    SELECT source, batch, part, hi - lo AS n, CASE WHEN held <= {CEILING} AND first % 7 = 0 THEN 2 ELSE 1 END AS attempts,
           CASE WHEN held > {CEILING} THEN 'too long' WHEN first % 14 = 0 THEN 'invalid' ELSE 'ok' END AS outcome FROM f"""
)
def g04_split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches whose reply would be too long are halved; replies that don't parse are asked for once more."""

    def reply(items: DataFrame) -> DataFrame:
        first = F.min("doc_id")
        valid = F.when(F.first("attempt") == 1, first % 7 != 0).otherwise(first % 14 != 0)
        return items.groupBy("source", "batch", "part").agg((F.sum("n_chars") > CEILING).alias("overflow"), valid.alias("valid"))

    return curation.in_halves(batched(spark, sf_dir), ["source", "batch"], "doc_id", reply)


@query(
    f"""WITH RECURSIVE {_BATCH_SQL}, e AS (SELECT source || '-' || batch AS run, place, n_chars % 30 AS item, list_distinct([doc_id % 30, (doc_id * 7) % 30]) AS also FROM i),
    f AS (SELECT run, 0::BIGINT AS place, []::BIGINT[] AS used, false AS took, NULL::BIGINT AS item, []::BIGINT[] AS fresh FROM (SELECT DISTINCT run FROM e)
      UNION ALL SELECT f.run, e.place, CASE WHEN list_contains(f.used, e.item) THEN f.used ELSE list_concat(list_append(f.used, e.item),
          list_filter(e.also, lambda a: a <> e.item AND NOT list_contains(f.used, a))) END, NOT list_contains(f.used, e.item), e.item,
          list_filter(e.also, lambda a: a <> e.item AND NOT list_contains(f.used, a))
      FROM f JOIN e ON e.run = f.run AND e.place = f.place + 1)
    SELECT run, place, item, array_to_string(list_sort(fresh), ',') AS also FROM f WHERE took"""
)
def u06_claimed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item and what it takes along are consumed once in a run."""
    also = F.array(F.col("doc_id") % 30, (F.col("doc_id") * 7) % 30)
    entries = batched(spark, sf_dir).select(
        F.concat_ws("-", "source", F.col("batch").cast("string")).alias("run"), F.col("place").cast("long").alias("place"),
        (F.col("n_chars") % 30).alias("item"), also.alias("also"),
    )
    told = curation.claimed(entries, "run", "place", "item", "also")
    return told.select("run", "place", "item", F.array_join(F.array_sort("also"), ",").alias("also"))


_IDS_SQL = "b AS (SELECT source, batch, list('i' || doc_id ORDER BY doc_id) AS ids FROM i GROUP BY ALL)"
_ENUM_SQL = "'[' || array_to_string(list_transform(ids[1:6], lambda x: '''' || x || ''''), ', ') || CASE WHEN len(ids) > 6 THEN ', …' ELSE '' END || ']'"


def live_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: F.concat(F.lit("i"), x))
    return batched(spark, sf_dir).groupBy("source", "batch").agg(ids.alias("ids"))


@query(f"""WITH {_BATCH_SQL}, {_IDS_SQL} SELECT source, batch, {_ENUM_SQL} AS shown FROM b""")
def x21_enum_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_ids(spark, sf_dir).select("source", "batch", curation.enum_text(F.col("ids")).alias("shown"))


@query(
    f"""WITH {_BATCH_SQL}, {_IDS_SQL}, t AS (SELECT source, batch, {_ENUM_SQL} AS live, len(ids)::VARCHAR AS n FROM b)
    SELECT source, batch, path, rule, CASE bound WHEN 'live' THEN live WHEN 'n' THEN n ELSE bound END AS bound FROM t, (VALUES
      ('$.tiers', 'maxItems', '3'), ('$.tiers[].tier', 'enum', '[''1'', ''2'', ''3'']'), ('$.tiers[].items', 'maxItems', 'n'),
      ('$.tiers[].items[].id', 'enum', 'live'), ('$.tiers[].items[].also', 'maxItems', '4'), ('$.tiers[].items[].also[]', 'enum', 'live'),
      ('$.tiers[].items[].confidence', 'enum', '[''HIGH'', ''MEDIUM'', ''LOW'']'), ('$.tiers[].items[].why', 'maxLength', '240'),
      ('$.tiers[].items[].follow_up', 'maxLength', '160')) r(path, rule, bound)"""
)
def v01_reply_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reply about each batch must keep to, with its live ids."""
    return curation.reply_constraints(live_ids(spark, sf_dir), "ids", 3, 4, {"why": 240, "follow_up": 160})


_WORDS = ("--flash", "--threads", "8", "--threads", "many", "--evil", "--no-map", "--batch", "512")


@query(
    """WITH RECURSIVE v AS (SELECT ['--flash', '--threads', '8', '--threads', 'many', '--evil', '--no-map', '--batch', '512'] AS w),
    t AS (SELECT p_partkey, list_transform(range(1, p_size % 7 + 1), lambda i: w[((p_partkey * i + i * i) % 9 + 1)::INT]) AS tokens FROM part, v),
    f AS (SELECT p_partkey, tokens, 0 AS pos, NULL::VARCHAR AS flag, []::VARCHAR[] AS seen, []::VARCHAR[] AS told FROM t UNION ALL
      SELECT p_partkey, tokens, pos + 1,
        CASE WHEN flag IS NULL AND x IN ('--threads', '--batch') THEN x END,
        CASE WHEN flag IS NULL AND x IN ('--flash', '--no-map', '--threads', '--batch') THEN list_append(seen, x) ELSE seen END,
        CASE WHEN flag IS NOT NULL AND regexp_full_match(x, '[0-9]+') THEN told WHEN flag IS NOT NULL THEN list_append(told, flag || ' ' || x || ': value must be a number')
             WHEN x NOT IN ('--flash', '--no-map', '--threads', '--batch') THEN list_append(told, x || ' is not whitelisted')
             WHEN list_contains(seen, x) THEN list_append(told, x || ' given twice') ELSE told END
      FROM (SELECT *, tokens[pos + 1] AS x FROM f WHERE pos < len(tokens)))
    SELECT p_partkey, array_to_string(CASE WHEN flag IS NOT NULL THEN list_append(told, flag || ' needs a value') ELSE told END, '; ') AS problems FROM f WHERE pos = len(tokens)"""
)
def v05_flag_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra arguments, token by token: whitelisted, once each, with values where they need one."""
    words = F.array(*map(F.lit, _WORDS))
    n = (F.col("p_size") % 7).cast("int")
    picked = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(words, ((F.col("p_partkey") * i + i * i) % 9 + 1).cast("int")))
    tokens = F.when(n > 0, picked).otherwise(F.array().cast("array<string>"))
    number = ("^[0-9]+$", "a number")
    told = curation.flag_problems(tokens, ("--flash", "--no-map"), {"--threads": number, "--batch": number})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(told, "; ").alias("problems"))


_TICKS_SQL = "t AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)::BIGINT // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", seconds.alias("s"))


@query(
    f"""WITH RECURSIVE {_TICKS_SQL}, f AS (SELECT user_id, event_id, n, s, 2::DOUBLE AS left_, true AS passed FROM t WHERE n = 1 UNION ALL
      SELECT t.user_id, t.event_id, t.n, t.s, CASE WHEN least(3.0, f.left_ + (t.s - f.s) / 14400.0) >= 1 THEN least(3.0, f.left_ + (t.s - f.s) / 14400.0) - 1 ELSE least(3.0, f.left_ + (t.s - f.s) / 14400.0) END,
        least(3.0, f.left_ + (t.s - f.s) / 14400.0) >= 1 FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
    SELECT event_id, passed FROM f"""
)
def g06_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens a client at most, one more every four hours; a request without a token is refused."""
    return folds.token_bucket(ticks(spark, sf_dir), ["user_id"], "s", ["ts", "event_id"], 3, 14_400).select("event_id", "passed")


@query(
    f"""WITH RECURSIVE {_TICKS_SQL}, f AS (SELECT user_id, event_id, n, 202 AS status, s + 36000 AS busy FROM t WHERE n = 1 UNION ALL
      SELECT t.user_id, t.event_id, t.n, CASE WHEN t.s < f.busy THEN 409 ELSE 202 END, CASE WHEN t.s < f.busy THEN f.busy ELSE t.s + 36000 END
      FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
    SELECT event_id, status FROM f"""
)
def r06_one_run_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request starts a run of ten hours, unless one of its key goes on."""
    return folds.one_at_a_time(ticks(spark, sf_dir), ["user_id"], "s", ["ts", "event_id"], 36_000).select("event_id", "status")


@query(
    f"""WITH RECURSIVE {_TICKS_SQL}, f AS (SELECT user_id, event_id, n, true AS polled, CASE WHEN event_type <> 'error' THEN s END AS at, CASE WHEN event_type <> 'error' THEN value END AS good FROM t WHERE n = 1 UNION ALL
      SELECT t.user_id, t.event_id, t.n, coalesce(t.s - f.at >= 14400, true), CASE WHEN coalesce(t.s - f.at >= 14400, true) AND t.event_type <> 'error' THEN t.s ELSE f.at END,
        CASE WHEN coalesce(t.s - f.at >= 14400, true) AND t.event_type <> 'error' THEN t.value ELSE f.good END
      FROM f JOIN t ON t.user_id = f.user_id AND t.n = f.n + 1)
    SELECT event_id, polled, good FROM f"""
)
def r07_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll is due four hours after the last good one; a failed poll leaves the last good value and is tried again."""
    failed = F.col("event_type") == "error"
    rows = ticks(spark, sf_dir).withColumn("read", F.when(~failed, F.col("value")))
    return folds.polled(rows, ["user_id"], "s", ["ts", "event_id"], "read", 14_400).select("event_id", "polled", "good")


@query(
    """WITH e AS (SELECT user_id * 10 + event_id // 700 % 10 AS run, event_id, event_type FROM events),
    c AS (SELECT *, coalesce(max((event_type IN ('purchase', 'error'))::INT) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
    SELECT run, count(*) AS steps, arg_max(event_type, event_id) AS last, arg_max(event_type, event_id) IN ('purchase', 'error') AS ended,
           CASE WHEN arg_max(event_type, event_id) IN ('purchase', 'error') THEN max(event_id) END AS ended_at FROM c WHERE done = 0 GROUP BY run"""
)
def r09_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log is only appended to; its state is its first final entry, else its last, as replayed from the log."""
    run = F.col("user_id") * 10 + F.floor(F.col("event_id") / 700) % 10
    entries = table(spark, sf_dir, "events").select(run.cast("long").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    return progress.states(entries, final=("purchase", "error"))


@query("""SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def k01_atomic_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is replaced as a whole: what readers find is one version or the other, here the second."""
    path = f"{shared_folder(spark)}/k01-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders")
    for rows in (orders, orders.where("o_orderstatus <> 'P'")):
        manifests.replace_if_changed(rows.groupBy("o_custkey").agg(F.count("*").alias("n")), path)
    return manifests.read(spark, path)


@query("""SELECT o_custkey, max(o_orderdate)::DATE AS newest, sum(o_totalprice)::DECIMAL(38,2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING max(o_orderkey) > 0""")
def k13_staged_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails its checks stays in quarantine: the table is the last version that passed, not the last written."""
    path = f"{shared_folder(spark)}/k13-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    totals = [F.max("o_orderdate").cast("date").alias("newest"), F.sum("price").cast("decimal(38,2)").alias("total")]
    good = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(*totals)
    broken = orders.groupBy("o_custkey").agg(F.lit(None).cast("date").alias("newest"), totals[1])
    for rows in (broken, good, broken):
        manifests.promote(rows, path, lambda written: written.where("newest is null or total is null"))
    return manifests.read(spark, path)


def digest_runs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The folders of output and state after two runs over documents that arrive as a stream."""
    folder = f"{shared_folder(spark)}/digest-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    for run in range(2):  # the second one starts anew and finds all it meets in the state
        arrived = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
        keyed = arrived.select("doc_id", F.md5("text").alias("key"))
        digest.run_digest(keyed, "key", "doc_id", f"{folder}/out", f"{folder}/state", f"{folder}/checkpoint-{run}", first=run).awaitTermination()
    return f"{folder}/out", f"{folder}/state"


@query("""SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY text""")
def r10_commit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output goes before state, so a run that is started again adds nothing and loses nothing."""
    return spark.read.parquet(digest_runs(spark, sf_dir)[0]).select("doc_id", "key")


@query("""SELECT DISTINCT md5(text) AS key FROM documents""")
def k04_state_after_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run leaves as state are the keys of what it has written."""
    return spark.read.parquet(f"{digest_runs(spark, sf_dir)[1]}/keys").select("key")


@query(
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id // 3, doc_id::VARCHAR) AS n FROM documents)
    SELECT lang AS watch, doc_id::VARCHAR AS key, (n - 1) // 50 + 1 AS run FROM r WHERE n <= 150"""
)
def r03_deferred_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of a stream: what the first found and couldn't take waits in its state, and comes oldest first."""
    at = lambda hours: F.lit("2024-06-01").cast("timestamp") + F.make_dt_interval(hours=hours)
    docs = table(spark, sf_dir, "documents")
    age = F.lit("2024-05-20").cast("timestamp") + F.make_dt_interval(secs=F.floor(F.col("doc_id") / 3))
    found = admission.arrivals(docs, F.col("lang"), F.col("source"), F.col("doc_id"), age)
    feeds = docs.select(F.col("lang").alias("watch"), "source").distinct()
    ended = lambda run: feeds.select("watch", "source", F.lit(None).cast("string").alias("key"), at(F.lit(run)).alias("at"), F.lit(True).alias("ok"))
    path = f"{shared_folder(spark)}/r03-{uuid.uuid4().hex}"
    for run in (1, 2, 3):
        arrived = ended(run).unionByName(found) if run == 1 else ended(run)
        arrived.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(admission.ARRIVALS).parquet(f"{path}/in")
        told = admission.admitted(stream, budget=50)

        def keep(rows: DataFrame, _: int, run: int = run) -> None:
            rows.where("kind = 'item'").select("watch", "key", F.lit(run).cast("long").alias("run")).write.mode("overwrite").parquet(f"{path}/out/{run}")

        with admission.state_store(spark):
            told.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()
    return spark.read.parquet(*(f"{path}/out/{run}" for run in (1, 2, 3))).select("watch", "key", "run")
