"""Readers and writers on invented inputs."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkreef.functions import dates
from sparkreef.plans.digest import digest_run
from sparkreef.sources import feeds, headers, sinks

RSS = """﻿ <?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One CVE-2024-12345</title><link>http://a/1</link><pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate><description>d1</description></item>
<item><title>Two</title><guid>http://a/2</guid><pubDate>6 Feb 24 10:00:00 +0200</pubDate></item><item><description>no title</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link rel="self" href="http://b/self"/><link href="http://b/3"/><updated>2024-02-07T00:00:00Z</updated><summary>s</summary></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="http://c/4"><title>Four</title><dc:date>2024-02-08</dc:date></item></rdf:RDF>"""
BODIES = {"rss.xml": RSS, "atom.xml": ATOM, "rdf.xml": RDF, "page.html": "<!DOCTYPE html><html></html>", "bad.xml": "<rss><channel>", "none.xml": "<rss><channel/></rss>"}


@pytest.fixture
def folder(tmp_path):
    for name, body in BODIES.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    return str(tmp_path)


def test_feeds_of_all_kinds(spark, folder):
    read = feeds.read_feeds(spark, folder)
    states = {r.path.rpartition("/")[2]: (r.ok, len(r["items"])) for r in read.collect()}
    assert states == {"rss.xml": (True, 2), "atom.xml": (True, 1), "rdf.xml": (True, 1), "page.html": (False, 0), "bad.xml": (False, 0), "none.xml": (True, 0)}
    items = {r.title: (r.link, r["at"] and r["at"].strftime("%m-%d %H")) for r in feeds.feed_items(read).collect()}
    assert items == {"One CVE-2024-12345": ("http://a/1", "02-05 10"), "Two": ("http://a/2", "02-06 08"), "Three": ("http://b/3", "02-07 00"), "Four": ("http://c/4", "02-08 00")}


def test_runs_record_every_item_once_and_then_nothing(spark, folder):
    seen = spark.createDataFrame([], "key string")
    state = spark.createDataFrame([], "source string, has_cutoff boolean, cutoff timestamp")
    common, now = F.lit("2024-02-01").cast("timestamp"), F.lit("2024-03-01").cast("timestamp")
    titles = []
    for _ in range(4):
        picked, next_seen, next_state = digest_run(spark, folder, seen, state, common, now, budget=2)
        titles += [r.title for r in picked.collect()]
        seen, state = (spark.createDataFrame(f.collect(), f.schema) for f in (next_seen, next_state))
    assert sorted(titles) == ["Four", "One CVE-2024-12345", "Three", "Two"]
    cut = {r.source: r.cutoff.strftime("%m-%d") for r in state.collect()}
    assert cut == {"rss": "03-01", "atom": "03-01", "rdf": "03-01", "none": "03-01", "page": "02-01", "bad": "02-01"}


def test_catalogs_indexes_and_advisories(spark, tmp_path):
    (tmp_path / "kev.json").write_text(json.dumps({"catalogVersion": "v", "vulnerabilities": [{"cveID": f"CVE-{i}", "dateAdded": f"2024-01-{i:02}"} for i in range(1, 31)]}))
    top = feeds.read_catalog(spark, str(tmp_path / "kev.json")).collect()
    assert len(top) == 25 and top[0].cveID == "CVE-30" and top[0].total == 30
    (tmp_path / "changes.csv").write_text('"2024/a.json","2024-01-02T03:04:05Z"\n"2024/b.txt","2024-01-02T03:04:05Z"\n')
    assert [r.path for r in feeds.read_changes(spark, str(tmp_path / "changes.csv")).collect()] == ["2024/a.json"]
    (tmp_path / "doc.json").write_text(json.dumps({"document": {"title": "T", "notes": [{"category": "x", "text": "n"}, {"category": "summary", "text": "s"}], "references": [{"category": "self", "url": "u"}], "tracking": {"id": "I", "current_release_date": "2024-05-06T00:00:00Z"}}}))
    row = feeds.read_advisories(spark, str(tmp_path / "doc.json")).first()
    assert (row.id, row.link, row.about) == ("I", "u", "s")


def test_a_source_that_fails_is_a_row(spark):
    def broken():
        raise OSError("down")

    union, states = feeds.collected({"a": lambda: spark.range(2), "b": broken})
    assert union.count() == 2 and states == [("a", None), ("b", "down")]


def packed(text):
    raw = text.encode()
    return struct.pack("<Q", len(raw)) + raw


def header(version=3, kv=(("general.alignment", 4, struct.pack("<I", 64)), ("arch", 8, packed("x")), ("list", 9, struct.pack("<IQ", 4, 2) + struct.pack("<II", 5, 6)))):
    body = b"GGUF" + struct.pack("<IQQ", version, 1, len(kv))
    for key, kind, value in kv:
        body += packed(key) + struct.pack("<I", kind) + value
    return body + packed("w") + struct.pack("<I", 2) + struct.pack("<QQ", 8, 4) + struct.pack("<IQ", 0, 0)


def test_binary_headers(spark, tmp_path):
    good = header()
    for name, data in {"good": good + b"\0" * 99, "cut": good[:-3], "magic": b"XXXX" + good[4:], "twice": header(kv=(("a", 0, b"\1"),) * 2)}.items():
        (tmp_path / name).write_bytes(data)
    found = {r.path.rpartition("/")[2]: r for r in headers.read_headers(spark, str(tmp_path)).collect()}
    assert found["good"].kv == {"general.alignment": "64", "arch": '"x"', "list": "[5, 6]"}
    assert found["good"].tensors[0].shape == [8, 4] and found["good"].header_bytes % 64 == 0
    assert all(found[n].error for n in ("cut", "magic", "twice"))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 120), st.binary(min_size=1, max_size=8))
def test_header_parser_takes_any_change(at, junk):
    data = header()
    headers.parse_header(data[:at] + junk + data[at + len(junk) :])


def test_feeds_with_odd_items(spark):
    """The first date by its tag's rank, first link without an alternate, names in any space, entities refused."""
    item = '<item xmlns:d="x"><title> A\n b </title><updated>2025-01-01</updated><d:date>2024-01-01</d:date><link>http://x</link></item>'
    bodies = {
        "order": f"<rss><channel>{item}</channel></rss>",
        "self": '<feed><entry><title>t</title><link rel="self" href="h1"/><id>http://id</id></entry></feed>',
        "guid": "<rss><channel><item><guid>tag:1</guid></item><item><guid>https://g</guid></item></channel></rss>",
        "entity": '<!DOCTYPE x><rss/>',
        "declared": '<rss><!ENTITY a "b"></rss>',
        "other": "<opml><body/></opml>",
        "null": None,
    }
    rows = spark.createDataFrame(list(bodies.items()), "k string, body string")
    found = {r.k: r for r in feeds.parsed_feeds(rows, "body").collect()}
    assert [(i.title, i.link, i.date) for i in found["order"]["items"]] == [("A b", "http://x", "2024-01-01")]
    assert [i.link for i in found["self"]["items"]] == ["h1"] and [i.link for i in found["guid"]["items"]] == ["https://g"]
    assert {k: found[k].error for k in ("entity", "declared", "other", "null")} == {
        "entity": "not a feed", "declared": "entities are refused", "other": "not a feed: opml", "null": "not a feed",
    }


def test_dates_of_all_forms(spark):
    forms = {"Mon, 05 Jan 26 10:00:00 GMT": "2026-01-05 10", "5 Jan 99 10:00:00 +0000": "1999-01-05 10", "2026-01-05T10:00:00+02:00": "2026-01-05 08", "2026-01-05": "2026-01-05 00", "": None, "junk": None}
    rows = spark.createDataFrame([(k,) for k in forms], "t string").select("t", F.date_format(dates.parse_date(F.col("t")), "yyyy-MM-dd HH").alias("d"))
    assert {r.t: r.d for r in rows.collect()} == forms
