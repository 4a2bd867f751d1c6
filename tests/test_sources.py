"""Readers and writers on small files."""

import csv
import glob
import gzip
import json

from pyspark.sql import functions as F

from listingflow.plans.listing_run import run
from listingflow.plans.queries_listings import RULES
from listingflow.sources import html as H
from listingflow.sources import stores


def test_json_store_round_trip_and_missing_file(spark, tmp_path):
    path = tmp_path / "store.json"
    assert stores.read_json_array(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"title": "a", "company": "b", "extra": 1}, {"title": "c", "url": None}]))
    rows = stores.read_json_array(spark, str(path)).orderBy("title").collect()
    assert [r["title"] for r in rows] == ["a", "c"] and rows[0]["company"] == "b"
    out = str(tmp_path / "out.json")
    stores.write_json(stores.read_json_array(spark, str(path)), out)
    assert spark.read.json(out).count() == 2


def test_store_append_and_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("a", "s1"), ("b", "s2")], "title string, source string")
    assert stores.read_store(spark, path, df.schema).count() == 0
    stores.write_store(df, path, partition_by=["source"])
    plan = stores.read_store(spark, path, df.schema).where("source = 's1'")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull" in plan._jdf.queryExecution().executedPlan().toString()
    cache = str(tmp_path / "cache")
    stores.append_rows(df, cache)
    stores.append_rows(df, cache)
    assert spark.read.parquet(cache).count() == 4


def test_progress_and_health_maps(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{\n "k1": {"status": "done", "folder": "f"},\n "k2": {"status": "reused"}\n}')
    bad.write_text("{not json")
    rows = {r["job_key"]: (r["status"], r["folder"]) for r in stores.read_progress(spark, str(good)).collect()}
    assert rows == {"k1": ("done", "f"), "k2": ("reused", None)}
    assert stores.read_health(spark, str(bad)).count() == 0
    assert stores.read_health(spark, str(tmp_path / "none.json")).count() == 0
    good.write_text('{"S": {"last_run": "x", "jobs_found": 3, "healthy": true}}')
    assert stores.read_health(spark, str(good)).first()["jobs_found"] == 3


def test_rules_and_profiles(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"name": "a"}, {"name": "b", "limit": 4}]')
    got = {r["name"]: r["limit"] for r in stores.read_rules(spark, str(path), "name string, limit int", {"limit": 9}).collect()}
    assert got == {"a": 9, "b": 4}
    (tmp_path / "cv.txt").write_text("line one\nline two")
    assert stores.read_profiles(spark, str(tmp_path / "cv.txt")).first()["text"] == "line one\nline two"


def test_run_stats_are_nested_and_appended(spark, tmp_path):
    stats = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "source string, queries long, jobs_found long")
    totals = spark.sql("select date'2024-01-02' as date, 5L as total_scraped, 4L as total_scored, 3L as recommended")
    row = stores.run_stats_row(totals, stats, F.lit(1.5))
    path = str(tmp_path / "stats")
    stores.append_rows(row, path)
    stores.append_rows(row, path)
    saved = spark.read.parquet(path).collect()
    assert len(saved) == 2 and saved[0]["sources"]["b"]["jobs_found"] == 4 and saved[0]["date"] == "2024-01-02"
    single = tmp_path / "one.json"
    single.write_text('{"date": "d", "total_scraped": 1, "sources": {"x": {"queries": 2}}}')
    assert stores.read_run_stats(spark, str(single)).first()["sources"]["x"]["queries"] == 2


def test_csv_reports(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', None, 1.5, "why")], "title string, company string, score double, reason string")
    path = str(tmp_path / "r")
    stores.write_report(stores.recommended_report(df), path)
    rows = [r for f in glob.glob(path + "/*.csv") for r in csv.reader(open(f, newline=""))]
    header = [r for r in rows if r[0] == "title"]
    data = [r for r in rows if r[0] != "title"]
    assert header and header[0][:5] == ["title", "company", "location", "category", "score"]
    assert data == [['say "hi", you', "", "", "", "1.5", "", "", "", "", "", "", "why"]]


def test_landed_pages_gzip_and_bad_bytes(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>\xff</p>")
    with gzip.open(tmp_path / "b.txt.gz", "wb") as f:
        f.write("<p>é</p>".encode())
    assert [r["html"] for r in H.landed_pages(spark, str(tmp_path / "a.html")).collect()] == ["<p>�</p>"]
    assert [r["html"] for r in H.landed_pages(spark, str(tmp_path / "b.txt.gz")).collect()] == ["<p>é</p>"]


def page(spark, html):
    return spark.createDataFrame([(1, html, "two words", "here")], "page_id int, html string, keyword string, location_hint string")


def test_embedded_json_paths_and_fallbacks(spark):
    def marker(text):
        return H.marker_json_listings(page(spark, text), ["page_id"], "https://b").collect()

    got = marker('x window._initialData= {"a":"}","metaData":{"results":[{"jobkey":"k","jobTitle":" T ","snippet":"<b>s</b>&amp;"},{"title":"no key"}]}}; tail }')
    assert [(r["job_id"], r["title"], r["location"], r["description"]) for r in got] == [("indeed_k", "T", "here", "s &")]
    got = marker('window._initialData={broken window.mosaic.providerData={"jobs":[{"jk":"m"}]}')
    assert [r["job_id"] for r in got] == ["indeed_m"]
    assert marker("") == [] and marker("<html></html>") == []

    tag = '<script type="application/json" id="__NEXT_DATA__">%s</script>'
    rows = [{"jobId": "1", "title": "a", "placeholders": [{"label": "P"}]}, {"id": "1", "title": "b"}, {"title": "c"}, {"title": "d"}]
    text = tag % json.dumps({"props": {"pageProps": {"searchResults": {"jobDetails": rows}}}})
    got = H.tag_json_listings(page(spark, text), ["page_id"]).orderBy("pos").collect()
    assert [(r["title"], r["location"], r["job_id"]) for r in got] == [("a", "P", "1"), ("c", "here", ""), ("d", "here", "")]


def test_whole_run(spark):
    rows = [(0, "BLUE RING - x", "c1", "Remote", "s", "small", "u1", "the ring 2 years"), (1, "blue ring  x", "c1", "remote", "s", "small", "u2", ""),
            (2, "BAD THING", "c2", "x", "s", "small", "", ""), (3, "NEW ROD", "c3", "x", "s", "x", "u3", "")]
    df = spark.createDataFrame(rows, "ord long, title string, company string, location string, source string, category string, url string, description string")
    df = df.withColumn("posted", F.lit("2024-01-10").cast("date")).withColumn("job_id", F.col("url"))
    profile = spark.createDataFrame([("that economy ring",)], "text string")
    store = df.where("ord = 3")
    out = run(df, store, profile, RULES, F.lit("2024-01-10").cast("date"), ["bad"], min_score=0.0, target=5)
    assert out.rejected.count() == 1 and sorted(r["ord"] for r in out.kept.collect()) == [0, 1, 3]
    assert sorted(r["ord"] for r in out.new.collect()) == [0, 1]
    assert [r["rank"] for r in out.recommended.orderBy("rank").collect()] == [1, 2]
