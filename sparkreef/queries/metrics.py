"""Metric samples: events play them. A series is an event type and a device (user_id % 8), its value
whole cents; the counter is the running sum of a series that starts anew every 50 samples."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkreef.operators import alerts, rules, timeseries, topn
from sparkreef.operators.lineage import shared_folder
from sparkreef.queries import query, table
from sparkreef.sources import sinks, targets
from sparkreef.streaming import conflation

_SAMPLES_SQL = """samples AS (SELECT event_id, ts, event_type AS metric, (user_id % 8)::INT AS device, user_id,
    round(value * 100)::BIGINT AS cents, props FROM events)"""
_COUNTER_SQL = f"""{_SAMPLES_SQL}, numbered AS (SELECT *, (row_number() OVER (PARTITION BY metric, device ORDER BY ts, event_id) - 1) // 50 AS life FROM samples),
    counter AS (SELECT event_id, ts, metric, device, sum(cents) OVER (PARTITION BY metric, device, life ORDER BY ts, event_id)::BIGINT AS total FROM numbered),
    steps AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN total < before THEN total ELSE total - before END AS step FROM
        (SELECT *, lag(total) OVER (PARTITION BY metric, device ORDER BY ts, event_id) AS before FROM counter))"""
LABELS = ["metric", "device"]
END = "2024-01-31 00:00:00"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("metric"), (F.col("user_id") % 8).cast("int").alias("device"), "user_id",
        F.round(F.col("value") * 100).cast("long").alias("cents"), "props",
    )


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    order = W.partitionBy(*LABELS).orderBy("ts", "event_id")
    lived = rows.withColumn("life", F.floor((F.row_number().over(order) - 1) / 50))
    total = F.sum("cents").over(W.partitionBy(*LABELS, "life").orderBy("ts", "event_id"))
    return lived.select("event_id", "ts", *LABELS, total.alias("total"))


def latest(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.max_by(value, F.struct("ts", "event_id")).alias(value))


@query(
    f"""WITH {_SAMPLES_SQL} SELECT metric, device, arg_max(cents, (ts, event_id)) AS cents FROM samples
    WHERE ts <= TIMESTAMP '2024-01-20' AND ts > TIMESTAMP '2024-01-19' GROUP BY metric, device"""
)
def s15_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sample of each series within the look-back before an instant."""
    day = (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("ts") > F.lit("2024-01-19").cast("timestamp_ntz"))
    return latest(samples(spark, sf_dir).where(day), LABELS, "cents")


@query(
    f"""WITH {_SAMPLES_SQL}, grid AS (SELECT unnest(range(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-04', INTERVAL 6 HOURS)) AS g),
    met AS (SELECT metric, device, g, arg_max(cents, (ts, event_id)) AS cents FROM grid JOIN samples ON ts <= g AND ts > g - INTERVAL 12 HOURS GROUP BY ALL)
    SELECT metric, device, epoch(g)::BIGINT AS grid, cents FROM met"""
)
def s16_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-02", "2024-01-03 18:00:00"))
    steps = timeseries.resampled(samples(spark, sf_dir), LABELS, "ts", "cents", "event_id", start, end, 21_600, 43_200)
    return steps.select(*LABELS, F.unix_timestamp("grid").alias("grid"), "cents")


@query(
    f"""WITH {_SAMPLES_SQL}, grid AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS g),
    met AS (SELECT metric, g, arg_max(cents, (ts, event_id)) AS cents FROM grid JOIN samples ON ts <= g AND ts > g - INTERVAL 1 HOUR GROUP BY ALL)
    SELECT metric, epoch(g)::BIGINT AS grid, cents FROM met"""
)
def w02_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-01", "2024-01-30 23:00:00"))
    steps = timeseries.resampled(samples(spark, sf_dir), ["metric"], "ts", "cents", "event_id", start, end, 3600, 3600)
    return steps.select("metric", F.unix_timestamp("grid").alias("grid"), "cents")


@query(
    f"""WITH {_COUNTER_SQL} SELECT event_id, metric, device, sum(step) OVER (PARTITION BY metric, device ORDER BY ts
        RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS increase FROM steps"""
)
def w03_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = timeseries.rate_raw(counter(spark, sf_dir), LABELS, "ts", "total", "event_id", 21_600)
    return rated.select("event_id", *LABELS, F.col("increase").cast("long").alias("increase"))


@query(
    f"""WITH {_COUNTER_SQL}, r AS (SELECT metric, device, ts, event_id, sum(step) OVER (PARTITION BY metric, device ORDER BY ts
        RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS increase FROM steps)
    SELECT metric, device, round(arg_max(increase, (ts, event_id)) / 86400.0, 4) AS rate FROM r GROUP BY metric, device"""
)
def w03_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' rate over the day up to its last sample."""
    rated = timeseries.rate_raw(counter(spark, sf_dir), LABELS, "ts", "total", "event_id", 86_400)
    return latest(rated, LABELS, "rate").withColumn("rate", F.round("rate", 4))


@query(
    f"""WITH {_COUNTER_SQL} SELECT metric, device, sum(step)::BIGINT AS today FROM steps
    WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '{END}' GROUP BY metric, device"""
)
def w04_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increase since midnight in the zone of display, a minute at least; now is the last microsecond before END."""
    now = F.timestamp_micros(F.unix_micros(F.lit(END).cast("timestamp")) - 1)
    midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, "UTC")), "UTC")
    since = F.least(midnight, now - F.make_dt_interval(mins=F.lit(1)))
    stepped = timeseries.increases(counter(spark, sf_dir), LABELS, "ts", "total", "event_id")
    today = stepped.where((F.col("ts").cast("timestamp") >= since) & (F.col("ts").cast("timestamp") <= now))
    return today.groupBy(*LABELS).agg(F.sum("step").cast("long").alias("today"))


@query(
    f"""WITH {_SAMPLES_SQL}, c AS (SELECT *, (cents // 1000 <> lag(cents // 1000) OVER (PARTITION BY metric, device ORDER BY ts, event_id))::INT AS changed FROM samples),
    w AS (SELECT event_id, sum(coalesce(changed, 0)) OVER (PARTITION BY metric, device ORDER BY ts RANGE BETWEEN INTERVAL 15 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS changes FROM c)
    SELECT * FROM w WHERE changes >= 2"""
)
def w05_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = samples(spark, sf_dir).withColumn("level", F.floor(F.col("cents") / 1000))
    changed = timeseries.changes(coarse, LABELS, "ts", "level", "event_id", 54_000)
    return changed.where("changes >= 2").select("event_id", "changes")


@query(
    """WITH a AS (SELECT event_id, user_id % 8 AS device, ts, ts - INTERVAL 3 HOURS * (event_id % 3) AS clock FROM events),
    k AS (SELECT *, max(clock) OVER (PARTITION BY device ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a),
    good AS (SELECT * FROM k WHERE newest IS NULL OR clock > newest)
    SELECT event_id, count(*) OVER (PARTITION BY device ORDER BY clock RANGE BETWEEN INTERVAL 1860 SECONDS PRECEDING AND CURRENT ROW) AS held FROM good"""
)
def w07_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points older than one that came before are rejected; how many a ring of half an hour holds."""
    clock = F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(0), (F.col("event_id") % 3 * 3).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 8).alias("device"), clock.alias("clock"))
    before = W.partitionBy("device").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    good = rows.withColumn("newest", F.max("clock").over(before)).where("newest is null or clock > newest")
    return timeseries.windowed(good, ["device"], "clock", 1860, held=F.lit(1)).select("event_id", "held")


@query(
    """WITH c AS (SELECT user_id, ts, event_id, value > 30 AS on_ FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, on_ ORDER BY ts, event_id) AS island FROM c)
    SELECT user_id, epoch_us(min(ts)) AS since, epoch_us(max(ts)) AS until,
           CASE WHEN max(ts) - min(ts) >= INTERVAL 6 HOURS THEN 'firing' ELSE 'pending' END AS state FROM i WHERE on_ GROUP BY user_id, island"""
)
def w08_alert_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = alerts.holds(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", F.col("value") > 30, 21_600)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return held.select("user_id", micros("since"), micros("until"), "state")


@query(
    """WITH b AS (SELECT event_id, count(*) OVER (PARTITION BY user_id % 16 ORDER BY ts RANGE BETWEEN INTERVAL 10 HOURS PRECEDING AND CURRENT ROW) AS hits
    FROM events WHERE event_type = 'error') SELECT * FROM b WHERE hits >= 5"""
)
def w10_threshold_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("address", F.col("user_id") % 16)
    return alerts.threshold_hits(errors, ["address"], "ts", 5, 36_000).select("event_id", "hits")


@query(
    """SELECT user_id, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 3"""
)
def w11_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys over their number per period, in fixed periods."""
    windowed = table(spark, sf_dir, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"))
    over = windowed.agg(F.count("*").alias("n")).where("n > 3")
    return over.select("user_id", F.unix_timestamp("w.start").alias("day"), "n")


@query(
    f"""WITH {_SAMPLES_SQL} SELECT metric, device, max(ts) < TIMESTAMP '{END}' - INTERVAL 8 HOURS AS stale FROM samples GROUP BY metric, device"""
)
def w12_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.stale(samples(spark, sf_dir), LABELS, "ts", F.lit(END), 28_800)
    return found.select(*LABELS, "stale")


@query(
    """WITH RECURSIVE b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le) GROUP BY event_type, le),
    p AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.999::DOUBLE]) AS phi),
    r AS (SELECT phi, event_type, le, n, lag(le, 1, 0.0) OVER w AS low, lag(n, 1, 0) OVER w AS before, phi * max(n) OVER (PARTITION BY phi, event_type) AS rank
          FROM b, p WINDOW w AS (PARTITION BY phi, event_type ORDER BY le))
    SELECT event_type, phi, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - before) / (n - before)::DOUBLE END AS q
    FROM r WHERE before < rank AND rank <= n"""
)
def a06_histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]
    counts = [F.count_if(F.col("value") <= b) for b in bounds]
    wide = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.array(*(F.struct(F.lit(b).alias("le"), n.alias("n")) for b, n in zip(bounds, counts, strict=True))).alias("b")
    )
    buckets = wide.select("event_type", F.inline("b"))
    found = None
    for phi in (0.5, 0.95, 0.999):
        one = timeseries.histogram_quantile(buckets, ["event_type"], "le", "n", phi)
        one = one.select("event_type", F.lit(phi).alias("phi"), F.col("quantile").alias("q"))
        found = one if found is None else found.unionByName(one)
    return found


@query(f"""WITH {_COUNTER_SQL} SELECT sum(step)::BIGINT AS total, count(*) AS n FROM steps""")
def a01_sum_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = timeseries.increases(counter(spark, sf_dir), LABELS, "ts", "total", "event_id")
    return stepped.agg(F.sum("step").cast("long").alias("total"), F.count("*").alias("n"))


@query(f"""WITH {_COUNTER_SQL} SELECT metric, sum(step)::BIGINT AS total FROM steps GROUP BY metric""")
def a02_sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    stepped = timeseries.increases(counter(spark, sf_dir), LABELS, "ts", "total", "event_id")
    return stepped.groupBy("metric").agg(F.sum("step").cast("long").alias("total"))


@query(
    f"""WITH {_COUNTER_SQL}, s AS (SELECT device, sum(step) / 2592000.0 AS rate FROM steps WHERE metric = 'view' GROUP BY device)
    SELECT round(100 * (1 - avg(rate)), 4) AS busy FROM s"""
)
def a03_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred less the mean idle rate."""
    stepped = timeseries.increases(counter(spark, sf_dir).where("metric = 'view'"), LABELS, "ts", "total", "event_id")
    rates = stepped.groupBy("device").agg((F.sum("step") / 2_592_000).alias("rate"))
    return rates.agg(F.round(100 * (1 - F.avg("rate")), 4).alias("busy"))


@query(f"""WITH {_SAMPLES_SQL} SELECT metric, max(cents) AS most FROM samples GROUP BY metric""")
def a04_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("metric").agg(F.max("cents").alias("most"))


@query(
    """SELECT (SELECT count(*) FROM events WHERE value > 200) AS n, (SELECT count(*) FROM events WHERE event_type = 'gone') AS none,
    NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'gone') AS absent"""
)
def a05_count_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are 0 where nothing is; absent says so."""
    gone = F.col("event_type") == "gone"
    return table(spark, sf_dir, "events").agg(
        F.count_if(F.col("value") > 200).alias("n"), F.count_if(gone).alias("none"), (F.count_if(gone) == 0).alias("absent")
    )


@query(
    """WITH s AS (SELECT user_id % 8 AS device, arg_max(event_type, (ts, event_id)) <> 'error' AS up FROM events GROUP BY 1)
    SELECT count(*) FILTER (up) AS n_up, count(*) FILTER (NOT up) AS n_down, coalesce(string_agg(device::VARCHAR, ',' ORDER BY device) FILTER (NOT up), '') AS down FROM s"""
)
def a12_up_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("device")).agg(
        (F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("up")
    )
    failing = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("up"), F.col("device")))), lambda x: x.cast("string")), ",")
    return last.agg(F.count_if("up").alias("n_up"), F.count_if(~F.col("up")).alias("n_down"), failing.alias("down"))


@query(
    """WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS bad, max(value) AS top FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN bad > 16 THEN 'alert' WHEN top > 250 THEN 'degraded' ELSE 'ok' END AS level,
    concat_ws(',', CASE WHEN bad > 16 THEN 'alert' END, CASE WHEN top > 250 THEN 'degraded' END) AS reasons FROM g"""
)
def a13_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("bad"), F.max("value").alias("top")
    )
    return alerts.rolled_up(grouped, ["user_id"], [("alert", F.col("bad") > 16), ("degraded", F.col("top") > 250)], "ok")


@query(
    f"""WITH {_SAMPLES_SQL} SELECT device, round(avg(cents), 4) AS mean, max(cents) AS peak, count(*) FILTER (cents > 10000) * 15 AS seconds_over,
    string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics FROM samples GROUP BY device"""
)
def a17_device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("device").agg(
        F.round(F.avg("cents"), 4).alias("mean"), F.max("cents").alias("peak"),
        (F.count_if(F.col("cents") > 10_000) * 15).alias("seconds_over"),
        F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"),
    )


@query(
    """SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN round(value * 100) END), 4) AS mean,
    string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds,
    round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 4) AS ratio FROM events GROUP BY user_id"""
)
def a18_guarded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means skip nulls, ratios have no value over nothing."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    mean = F.avg(F.when(F.col("event_type") != "error", F.round(F.col("value") * 100)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.round(mean, 4).alias("mean"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
        F.round(F.try_divide(n("purchase"), n("view")), 4).alias("ratio"),
    )


_USAGE_SQL = """usage AS (SELECT CASE WHEN user_id % 10 IN (0, 1) THEN '(no alias)' ELSE 'k' || user_id % 10 END AS alias,
    count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, sum(round(value * 100))::BIGINT AS cents FROM events GROUP BY 1)"""


@query(f"WITH {_USAGE_SQL} SELECT * FROM usage")
def j05_nway_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the same keys put side by side in one aggregate; missing and "None" are one alias."""
    user = F.col("user_id") % 10
    raw = F.when(user == 0, F.lit(None)).when(user == 1, "None").otherwise(F.concat(F.lit("k"), user))
    alias = F.coalesce(F.nullif(raw, F.lit("None")), F.lit("(no alias)"))
    rows = table(spark, sf_dir, "events").withColumn("alias", alias)
    measures = {
        "requests": rows.select("alias", F.lit(1).alias("v")),
        "errors": rows.where("event_type = 'error'").select("alias", F.lit(1).alias("v")),
        "cents": rows.select("alias", F.round(F.col("value") * 100).cast("long").alias("v")),
    }
    union = None
    for name, measure in measures.items():
        one = measure.select("alias", F.lit(name).alias("measure"), F.col("v").cast("long").alias("v"))
        union = one if union is None else union.unionByName(one)
    sums = [F.coalesce(F.sum(F.when(F.col("measure") == name, F.col("v"))), F.lit(0)).alias(name) for name in measures]
    return union.groupBy("alias").agg(*sums)


@query(f"WITH {_USAGE_SQL} SELECT alias, requests, row_number() OVER (ORDER BY requests DESC, alias) AS rank FROM usage")
def a26_usage_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = j05_nway_outer(spark, sf_dir)
    return topn.top(usage, 1000, [F.desc("requests"), F.col("alias")]).select("alias", "requests", "rank")


@query(
    f"""WITH {_SAMPLES_SQL} SELECT metric, arg_max(cents, (ts, event_id)) FILTER (device <> 3) AS last, max(cents) AS most,
    CASE WHEN max(cents) >= 40000 THEN 'red' WHEN max(cents) >= 35000 THEN 'amber' ELSE 'green' END AS colour FROM samples GROUP BY metric"""
)
def a28_panel_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value that is there, the largest, and the colour of its threshold."""
    value = F.when(F.col("device") != 3, F.col("cents"))
    order = F.when(value.isNotNull(), F.struct("ts", "event_id"))
    most = F.max("cents")
    return samples(spark, sf_dir).groupBy("metric").agg(
        F.max_by(value, order).alias("last"), most.alias("most"),
        F.when(most >= 40_000, "red").when(most >= 35_000, "amber").otherwise("green").alias("colour"),
    )


@query(
    f"""WITH {_SAMPLES_SQL} SELECT device, arg_max(cents, (ts, event_id)) FILTER (metric = 'view') AS view, arg_max(cents, (ts, event_id)) FILTER (metric = 'click') AS click,
    arg_max(cents, (ts, event_id)) FILTER (metric = 'error') AS error FROM samples GROUP BY device HAVING count(*) FILTER (metric = 'view') > 0"""
)
def j03_pivot_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per device of the driving metric, the others beside it."""
    last = F.max_by("cents", F.struct("ts", "event_id"))
    wide = samples(spark, sf_dir).groupBy("device").pivot("metric", ["view", "click", "error"]).agg(last)
    return wide.where("view is not null").select("device", "view", "click", "error")


@query(
    f"""WITH {_SAMPLES_SQL}, l AS (SELECT metric, device, arg_max(cents, (ts, event_id)) AS v FROM samples GROUP BY ALL)
    SELECT a.device, round(a.v::DOUBLE / nullif(a.v + b.v, 0), 4) AS ratio FROM l a JOIN l b USING (device) WHERE a.metric = 'click' AND b.metric = 'view' AND a.v + b.v > 0"""
)
def j13_vector_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(samples(spark, sf_dir), LABELS, "cents").withColumnRenamed("cents", "value")
    used, free = (last.where(F.col("metric") == m).select("device", "value") for m in ("click", "view"))
    ratio = F.try_divide(F.col("left.value"), F.col("left.value") + F.col("right.value"))
    return timeseries.matched(used, free, ["device"], F.round(ratio, 4)).withColumnRenamed("value", "ratio")


@query(
    f"""WITH {_SAMPLES_SQL}, l AS (SELECT metric, device, arg_max(cents, (ts, event_id)) AS v FROM samples GROUP BY ALL),
    a AS (SELECT device, v FROM l WHERE metric = 'click' AND v > 3000)
    SELECT device, v AS value FROM a UNION ALL SELECT device, v FROM l WHERE metric = 'view' AND device NOT IN (SELECT device FROM a)"""
)
def j14_or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(samples(spark, sf_dir), LABELS, "cents").withColumnRenamed("cents", "value")
    one = last.where("metric = 'click' and value > 3000").select("device", "value")
    two = last.where("metric = 'view'").select("device", "value")
    return timeseries.or_else(one, two, ["device"])


@query(
    """WITH p AS (SELECT g, TIMESTAMP '2024-01-01' + to_hours(g * 6) AS pt FROM (SELECT unnest(range(120)) AS g)),
    m AS (SELECT g, event_id, abs(epoch_us(ts) - epoch_us(pt)) AS d FROM p JOIN events ON ts BETWEEN pt - INTERVAL 2 HOURS AND pt + INTERVAL 2 HOURS)
    SELECT g, arg_min(event_id, (d, event_id)) AS event_id FROM m GROUP BY g"""
)
def j21_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("timestamp")
    points = spark.range(120).select(F.col("id").alias("g"), (start + F.make_dt_interval(F.lit(0), (F.col("id") * 6).cast("int"))).alias("pt"))
    found = timeseries.nearest(points, table(spark, sf_dir, "events").select("event_id", "ts"), "pt", "ts", "event_id", 7200, "g")
    return found.select("g", "event_id")


@query(
    """SELECT event_type AS instance, 'job-' || (user_id % 2) AS job, count(*) AS n FROM events GROUP BY 1, 2"""
)
def j26_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels renamed and added, in a map as a scrape would have them."""
    labels = F.create_map(F.lit("model"), F.col("event_type"))
    more = F.create_map(F.lit("instance"), labels["model"], F.lit("job"), F.concat(F.lit("job-"), F.col("user_id") % 2))
    rows = table(spark, sf_dir, "events").select(F.map_concat(labels, more).alias("labels"))
    return rows.groupBy(F.col("labels")["instance"].alias("instance"), F.col("labels")["job"].alias("job")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {_SAMPLES_SQL}, v AS (SELECT device, max(cents) AS views FROM samples WHERE metric = 'view' AND device < 6 GROUP BY 1),
    e AS (SELECT device, max(cents) AS errors FROM samples WHERE metric = 'error' AND device > 1 GROUP BY 1)
    SELECT device AS gpu, views, errors FROM v FULL JOIN e USING (device)"""
)
def j28_merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables merged on the labels that they share, then organised."""
    rows = samples(spark, sf_dir)
    views = rows.where("metric = 'view' and device < 6").groupBy("device").agg(F.max("cents").alias("views"))
    errors = rows.where("metric = 'error' and device > 1").groupBy("device").agg(F.max("cents").alias("errors"))
    shared = [c for c in views.columns if c in errors.columns]
    return views.join(errors, shared, "full_outer").withColumnRenamed("device", "gpu")


@query(
    """WITH s AS (SELECT user_id, max(ts) AS last, max(value) AS top FROM events GROUP BY user_id)
    SELECT 'HighValue' AS name, user_id, CASE WHEN top > 200 THEN 'firing' ELSE 'pending' END AS state, substr('user ' || user_id || ' saw ' || round(top)::BIGINT, 1, 200) AS summary
    FROM s WHERE top > 150"""
)
def s17_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("value").alias("top")).where("top > 150")
    summary = F.format_string("user %d saw %d", "user_id", F.round("top").cast("long"))
    state = F.when(F.col("top") > 200, "firing").otherwise("pending")
    return tops.select(F.lit("HighValue").alias("name"), "user_id", state.alias("state"), F.substring(summary, 1, 200).alias("summary"))


@query(
    """SELECT device, count(*) AS n, round(avg(power), 4) AS mean_power, max(temp) AS peak_temp FROM
    (SELECT user_id % 8 AS device, round(value * 100)::BIGINT AS power, event_id % 90 AS temp FROM events) GROUP BY device"""
)
def s38_sampler_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampler lines, parsed from CSV text."""
    line = F.concat_ws(", ", F.col("user_id") % 8, F.round(F.col("value") * 100).cast("long"), F.col("event_id") % 90)
    parsed = F.from_csv(line, F.lit("device LONG, power LONG, temp LONG"), {"ignoreLeadingWhiteSpace": "true"})
    rows = table(spark, sf_dir, "events").select(parsed.alias("p")).select("p.*")
    return rows.groupBy("device").agg(F.count("*").alias("n"), F.round(F.avg("power"), 4).alias("mean_power"), F.max("temp").alias("peak_temp"))


@query(
    """SELECT event_type AS target, 'p' || user_id % 5 AS instance, count(*) AS n FROM events WHERE user_id % 5 <> 4 GROUP BY 1, 2"""
)
def s42_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered targets: the address becomes the parameter and the instance; dropped targets are left out."""
    address = F.concat(F.lit("p"), F.col("user_id") % 5)
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("__param_target"), address.alias("__address__"))
    kept = found.where(~F.col("__address__").rlike(rules.glob("p4")))
    return kept.withColumnsRenamed({"__param_target": "target", "__address__": "instance"}).groupBy("target", "instance").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id, arg_max((json_extract(props, '$.k'))::INT, event_id) AS k, max(event_id) AS at_line FROM events WHERE event_type = 'purchase' GROUP BY user_id"""
)
def s43_last_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a stream of JSON lines the last summary record, one field of it."""
    lines = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    parsed = lines.withColumn("record", F.from_json("props", F.lit("k INT")))
    return parsed.groupBy("user_id").agg(F.max_by("record.k", "event_id").alias("k"), F.max("event_id").alias("at_line"))


@query(
    """SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND event_type <> '' AND NOT regexp_full_match(event_type, 'cl.*k') AND regexp_full_match('u' || user_id, 'u1[0-9]*')"""
)
def f06_label_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label matchers; their patterns are anchored at both ends."""
    anchored = lambda c, p: c.rlike(f"^(?:{p})$")
    t = F.col("event_type")
    user = F.concat(F.lit("u"), "user_id")
    keep = anchored(t, "view|click") & (t != "") & ~anchored(t, "cl.*k") & anchored(user, "u1[0-9]*")
    return table(spark, sf_dir, "events").where(keep).select("event_id")


@query(f"""WITH {_SAMPLES_SQL}, d AS (SELECT event_id, cents - 20000 AS over FROM samples) SELECT * FROM d WHERE over > 0""")
def f07_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("event_id", (F.col("cents") - 20_000).alias("over")).where("over > 0")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events""")
def f08_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreef.functions.scalars import finite

    kind = F.col("event_id") % 20
    written = F.when(kind == 0, "NaN").when(kind == 5, "Infinity").when(kind == 10, "-Infinity").when(kind == 15, "n/a")
    return table(spark, sf_dir, "events").select("event_id", finite(F.coalesce(written, F.col("value").cast("string"))).alias("value"))


@query("""SELECT event_id FROM events WHERE (200 + event_id % 350) // 100 <> 2""")
def f18_status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.lit(200) + F.col("event_id") % 350).cast("string")
    return table(spark, sf_dir, "events").where(~code.rlike("^(?:2..)$")).select("event_id")


@query("""SELECT event_id FROM events WHERE event_type IN ('view', 'error')""")
def f20_dashboard_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of several values becomes an alternation."""
    chosen = "|".join(("view", "error"))
    return table(spark, sf_dir, "events").where(F.col("event_type").rlike(f"^(?:{chosen})$")).select("event_id")


@query(
    f"""WITH {_SAMPLES_SQL}, d AS (SELECT device, metric, max(cents) AS most FROM samples GROUP BY ALL)
    SELECT device, '[' || string_agg('{{"metric":"' || metric || '","most":' || most || '}}', ',' ORDER BY metric) || ']' AS snapshot FROM d GROUP BY device"""
)
def p08_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested snapshot per device, as JSON."""
    most = samples(spark, sf_dir).groupBy("device", "metric").agg(F.max("cents").alias("most"))
    return most.groupBy("device").agg(F.to_json(F.array_sort(F.collect_list(F.struct("metric", "most")))).alias("snapshot"))


@query(
    """SELECT 'model_up{model="' || event_type || '",user="u' || (user_id % 3) || '"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3"""
)
def k05_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of targets: a good write, then one that fails on a row, which leaves what was there."""
    counted = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model"), F.concat(F.lit("u"), F.col("user_id") % 3).alias("user")
    ).agg(F.count("*").alias("n"))
    lines = sinks.exposition(counted, "model_up", ["model", "user"], "n")
    path = f"{shared_folder(spark)}/k05-{uuid.uuid4().hex}"
    targets.put_up(lines, path)
    broken = lines.select(F.when(F.col("line").contains('user="u1"'), F.raise_error(F.lit("no target"))).otherwise(F.lit("half")).alias("line"))
    with contextlib.suppress(PySparkException):
        targets.put_up(broken, path)
    return targets.read_targets(spark, path)


@query(
    """SELECT event_id, max(CASE WHEN event_type <> 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_success FROM events"""
)
def k14_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed run keeps the time of the success before."""
    micros = F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp")))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.last(micros, ignorenulls=True).over(order).alias("last_success"))


@query("""SELECT event_id, round(value, 1) AS rounded, CASE WHEN event_id % 7 <> 0 THEN round(value * 3, 2) END AS guarded FROM events""")
def x27_null_safe_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarded = F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 3, 2))
    return table(spark, sf_dir, "events").select("event_id", F.round("value", 1).alias("rounded"), guarded.alias("guarded"))


@query(
    """SELECT event_id, least(40, greatest(1, (event_id * 3 - 512) // 240)) AS items FROM events WHERE event_id * 3 >= 512"""
)
def x37_chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkreef.functions.scalars import chunk_limit

    budget = F.col("event_id") * 3
    return table(spark, sf_dir, "events").where(budget >= 512).select("event_id", chunk_limit(budget).cast("long").alias("items"))


@query(
    """SELECT event_type, epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS hour, count(*) AS n FROM events GROUP BY 1, 2"""
)
def r11_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"))
    return windows.agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("w.start").alias("hour"), "n")


@query(
    """WITH g AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    s AS (SELECT *, sum((gap IS NULL OR gap >= INTERVAL 5 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, session"""
)
def r11_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "5 hours").alias("w"))
    return sessions.agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query(
    """SELECT user_id % 8 AS device, max(event_id) AS seq, arg_max(event_type, event_id) AS snapshot FROM events GROUP BY 1"""
)
def r08_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots arrive as a stream; clients find the newest of each device, whatever went by before they came."""
    arrived = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    snapshots = arrived.select((F.col("user_id") % 8).alias("device"), F.col("event_id").alias("seq"), F.col("event_type").alias("snapshot"))
    path = f"{shared_folder(spark)}/r08-{uuid.uuid4().hex}"
    conflation.conflate(snapshots, "device", "seq", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return conflation.seen_by(spark, f"{path}/table")[1].select("device", "seq", "snapshot")
