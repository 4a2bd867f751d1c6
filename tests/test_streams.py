"""Streaming jobs: replay adds nothing, and results equal one pass over all rows."""

import datetime
import random

from pyspark.sql import functions as F

from listingflow.defaults import SCORE_RULES
from listingflow.operators.health import zero_streaks
from listingflow.operators.scoring import score_entries, score_listings, text_bodies
from listingflow.streaming import jobs

SCHEMA = "ord long, job_id string, title string, company string, location string"


def land(df, path, column, parts):
    for i in range(parts):
        df.where(F.col(column) == i).drop(column).coalesce(1).write.parquet(f"{path}/part={i}")
    return f"{path}/*"


def test_ingest_is_exact_and_replay_adds_nothing(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["", str(rnd.randrange(40))]), f"t{rnd.randrange(5)}", f"c{rnd.randrange(5)}", f"l{rnd.randrange(3)}", i // 50) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA + ", part int")
    landed = land(df, str(tmp_path / "in"), "part", 3)
    store = str(tmp_path / "store")

    def once(checkpoint):
        jobs.ingest(jobs.file_stream(spark, landed, df.drop("part").schema), store, str(tmp_path / checkpoint))
        return sorted(r["ord"] for r in spark.read.parquet(store).collect())

    seen_id, seen_key, expected = set(), set(), []
    for ord_, jid, t, c, l, _ in rows:
        if (jid and jid in seen_id) or (t, c, l) in seen_key:
            continue
        if jid:
            seen_id.add(jid)
        seen_key.add((t, c, l))
        expected.append(ord_)
    assert once("c1") == expected
    assert once("c1") == expected  # nothing new has landed
    assert once("c2") == expected  # every batch is processed again under its old number


def test_health_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, start + datetime.timedelta(hours=i), 0 if rnd.random() < 0.8 else 2, i // 20) for i in range(60) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "source string, run_ts timestamp_ntz, jobs_found long, part int")
    landed = land(df, str(tmp_path / "in"), "part", 3)
    out = str(tmp_path / "out")
    jobs.health(jobs.file_stream(spark, landed, df.drop("part").schema), out, str(tmp_path / "c"))
    pick = lambda d: sorted((r["source"], r["run_ts"], r["consecutive_zero"], r["healthy"]) for r in d.collect())
    assert pick(spark.read.parquet(out)) == pick(zero_streaks(df.drop("part")))


def test_until_target_stops(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 5), i // 10) for i in range(30)], "ord long, score double, part int")
    landed = land(df, str(tmp_path / "in"), "part", 3)
    out = str(tmp_path / "out")
    jobs.until_target(jobs.file_stream(spark, landed, df.drop("part").schema), 3, 4.0, out, str(tmp_path / "c"))
    assert sorted(r["ord"] for r in spark.read.parquet(out).collect()) == list(range(15))


def test_arrivals_with_the_number_of_their_text_score_like_whole_ones(spark, tmp_path):
    """Landed listings carry a number; of equal pairs the first has the score."""
    texts = spark.createDataFrame([(0, "sql python"), (1, "excel 2 years")], "doc_id long, text string")
    rows = [(i, f"Data Analyst {i % 4}", f"c{i % 3}", "data_analyst", "Remote", "2024-01-10", i % 2, "3+ years") for i in range(24)]
    df = spark.createDataFrame(rows, "ord long, title string, company string, category string, location string, posted string, doc_id long, note string")
    profile = spark.createDataFrame([("Data Analyst, sql python. 4 years of experience",)], "text string")
    as_of = F.lit("2024-01-10").cast("date")
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    for i in range(2):
        df.where(F.floor(F.col("ord") / 12) == i).write.parquet(f"{landed}/slice={i}")
        stream = jobs.file_stream(spark, f"{landed}/*", df.schema)
        jobs.score_arrivals(stream, profile, SCORE_RULES, as_of, out, str(tmp_path / "c"), body="body", bodies=text_bodies(texts, SCORE_RULES))
    firsts = df.where("ord < 12").join(texts, "doc_id").withColumn("description", F.concat("text", F.lit(" "), "note")).drop("doc_id", "text", "note")
    expected = score_entries(score_listings(firsts, profile, SCORE_RULES, as_of))
    got = spark.read.parquet(out).select(expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.count() == 12
