"""Queries against their SQL on rows that the test tables don't have."""

import datetime

from pyspark.sql import functions as F

from compare import differences
from sparkreef.functions import text
from sparkreef.operators import rules
from sparkreef.queries import registry

QUERIES = registry()


def same_as_sql(spark, folder, name, **tables):
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/rows-{table}")
        (part,) = (folder / f"rows-{table}").glob("*.parquet")
        part.rename(folder / f"{table}.parquet")
    return differences(QUERIES[name].run(spark, str(folder)), QUERIES[name].oracle, folder)


def test_words_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["modèles", "lesé", "İles", "lesİ", "Kles", "THE", "_und", "und9", "x und.", None, "Üundß", "ıthe", "thė"]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    assert same_as_sql(spark, tmp_path, "s40_history_scan", conversations=rows) is None


def test_today_has_its_last_second(spark, tmp_path):
    at = lambda *x: datetime.datetime(2024, 1, *x)
    times = [at(29, 23, 59, 59, 999999), at(30), at(30, 12), at(30, 23, 59, 59), at(30, 23, 59, 59, 999999), at(31), at(31, 1)]
    rows = [(i, t, 8, "view", float(1 + i), "{}") for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    assert same_as_sql(spark, tmp_path, "w04_today", events=events) is None


def test_whole_words_end_where_ascii_ends(spark):
    lines = spark.createDataFrame([(1, "élicense"), (2, "xlicense"), (3, "the License."), (4, "licenseß CVE-2024-1234é")], "k int, line string")
    assert sorted(r.k for r in rules.scanned(lines, "line", (), ("license",), (), ()).collect()) == [1, 3, 4]
    assert lines.where("k = 4").select(text.advisory_id(F.col("line"))).first()[0] == "CVE-2024-1234"


def test_work_on_bodies_is_dealt_out(spark, small):
    """What reads bodies stands above the shuffle that gives many tasks of a small table."""
    for name, work in (("s06_feed_items", "from_xml"), ("s30_model_entries", "aggregate(")):
        plan = QUERIES[name].run(spark, small)._jdf.queryExecution().optimizedPlan().toString().lower()
        above, below = plan.split("repartitionbyexpression" if "repartitionbyexpression" in plan else "repartition ", 1)
        assert ("xml" in above if work == "from_xml" else work in above) and "xml" not in below and work not in below
