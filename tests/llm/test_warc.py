"""Revisits against a walk through sorted records."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm import warc

SCHEMA = "record_id long, url string, time long, kind string, etag string, last_modified string, headers map<string,string>, payload string, status int"


def walk(rows):
    """Base, status, headers and payload of each record by one pass per address."""
    out = {}
    for row in rows:
        own = row[2] if row[2] is not None else float("-inf")
        if row[3] != "revisit":
            out[row[0]] = (None, "full" if row[3] == "response" else None, row[6] or {}, row[7])
            continue
        earlier = [(r[2] if r[2] is not None else float("-inf"), r[0], r) for r in rows if r[3] == "response" and r[1] == row[1]]
        earlier = [e for e in earlier if (e[0], e[1]) < (own, row[0])]
        if not earlier:
            out[row[0]] = (None, "orphan", row[6] or {}, row[7])
            continue
        base = max(earlier, key=lambda e: e[:2])[2]
        tags = [x[4].removeprefix("W/") if x[4] else None for x in (row, base)]
        same = tags[0] == tags[1] if None not in tags else bool(row[5]) and row[5] == base[5]
        if not same:
            out[row[0]] = (base[0], "mismatch", row[6] or {}, row[7])
            continue
        fresh = {k: v for k, v in (row[6] or {}).items() if k in warc.PERMITTED}
        out[row[0]] = (base[0], "resolved", {**(base[6] or {}), **fresh}, base[7])
    return out


def records(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        url = rng.choice(["hot.example/a"] * 4 + ["b.example/x", None, "c.example/"])
        url = "hot.example/a" if url == "c.example/" and i % 2 else url
        time = rng.choice([None, *range(40)])
        kind = rng.choice(["response", "revisit", "revisit", "metadata", None])
        etag = rng.choice([None, "", '"1"', 'W/"1"', '"2"'])
        headers = rng.choice([None, {}, {"date": str(i), "content-length": "0"}, {"etag": "x", "server": "s", "vary": "v"}])
        rows.append((i, url if url != "c.example/" else "c.example", time, kind, etag, rng.choice([None, "", "m1", "m2"]), headers, f"body {i}" if kind == "response" else None, 304))
    return rows


@pytest.mark.parametrize("partitions", [1, 16])
def test_equals_a_walk(spark, partitions):
    rows = records(500)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    want = walk(rows)
    assert len(found) == len(rows)
    for row in found:
        assert (row.base_id, row.status, row.headers, row.payload) == want[row.record_id]


def test_canonical_urls(spark):
    urls = {
        "HTTPS://WWW.Example.ORG/Path/?utm_source=feed#top": "example.org/Path",
        "http://m.example.org/a.html": "example.org/a",
        "http://example.org/a?page=2&ref=x": "example.org/a?page=2",
        "example.org": "example.org",
        "": "",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.canonical_url("url").alias("c"))
    assert {r.url: r.c for r in rows.collect()} == urls


def test_repeats_and_empty_table(spark):
    rows = [(1, "a.b/c", 1, "response", '"1"', None, {"date": "1"}, "p", 200)] * 3 + [(2, "a.b/c", 2, "revisit", '"1"', None, None, None, 304)] * 2
    found = warc.resolve(spark.createDataFrame(rows, SCHEMA)).groupBy("status").agg(F.count("*").alias("n")).collect()
    assert {r.status: r.n for r in found} == {"full": 3, "resolved": 2}
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows_per_salt", [4096, 2])
def test_attached_bodies_equal_bodies_that_travelled(spark, monkeypatch, rows_per_salt):
    hot = warc.hot_keys
    monkeypatch.setattr(warc, "hot_keys", lambda df, keys: hot(df, keys, rows_per_salt))
    rows = records(400)
    light = spark.createDataFrame([(*r[:7], r[0] if r[7] is not None else None, r[8]) for r in rows], SCHEMA.replace("payload string", "payload long"))
    bodies = spark.createDataFrame([(r[0], r[7]) for r in rows if r[7] is not None] * 2, "body_id long, body string")
    found = warc.attach(warc.resolve(light), bodies).collect()
    want = walk(rows)
    assert len(found) == len(rows)
    for row in found:
        assert (row.base_id, row.status, row.headers, row.payload) == want[row.record_id]
    assert warc.attach(warc.resolve(light), bodies.limit(0)).where("payload IS NOT NULL").count() == 0
