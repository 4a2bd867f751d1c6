"""Streaming queries. Tables are landed in slices, then streamed to the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.plans.driver_tables import LISTINGS_SQL, as_of, bodies, listings, runs, table
from listingflow.plans.queries_events import _STREAKS
from listingflow.plans.queries_listings import MIN_SCORE, RULES, SCORED, _profile, _scored, _with_id, _WITH_ID
from listingflow.plans.registry import query, sql_fingerprint, sql_greedy
from listingflow.scratch import scratch_path
from listingflow.streaming import jobs


def in_slices(df: DataFrame, cuts: list[Column], job: Callable[[DataFrame], None]) -> None:
    """Land ``df`` slice by slice and run the streaming job after each, on one checkpoint.

    ``df`` is computed once, by a write that parts it into slices; landing a slice copies
    its files without a shuffle. All files of a slice are one micro-batch.
    """
    spark = df.sparkSession
    staged, path = scratch_path(spark, "staged"), scratch_path(spark, "landed")
    number = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        number = F.when(cut, i).otherwise(number)
    df.withColumn("slice", number).write.partitionBy("slice").parquet(staged)
    rows = spark.read.parquet(staged)
    for i in range(len(cuts) + 1):
        rows.where(F.col("slice") == i).drop("slice").write.parquet(f"{path}/slice={i}")
        job(jobs.file_stream(spark, f"{path}/*", df.schema))


def _read(df: DataFrame, out: str) -> DataFrame:
    return df.sparkSession.read.parquet(out).drop(jobs.BATCH)


def _date(day: str) -> Column:
    return F.lit(day).cast("date")


CUTS = ["1997-01-01", "1999-01-01"]
_SLICE = f"CASE WHEN posted < DATE '{CUTS[0]}' THEN 0 WHEN posted < DATE '{CUTS[1]}' THEN 1 ELSE 2 END"


def _by_date() -> list[Column]:
    return [F.col("posted") < _date(c) for c in CUTS]


@query("stream_ingest", f"""WITH {LISTINGS_SQL}, {_WITH_ID}, keyed AS (SELECT {_SLICE} * 1000000000000 + ord AS ord, title || chr(31) || company || chr(31) || location AS k1,
  nullif(job_id, '') AS k2 FROM ids), {sql_greedy('keyed', 8)}
SELECT i.ord, title, company, location, job_id FROM ids i JOIN kept k ON k.ord = {_SLICE} * 1000000000000 + i.ord""")
def stream_ingest(spark, d):
    source = _with_id(listings(spark, d, description=False))
    out, checkpoint = scratch_path(spark, "store"), scratch_path(spark, "checkpoint")
    in_slices(source, _by_date(), lambda stream: jobs.ingest(stream, out, checkpoint))
    return _read(source, out).select("ord", "title", "company", "location", "job_id")


@query("stream_scores", f"""{SCORED} SELECT title, company, score FROM (SELECT *, row_number() OVER (PARTITION BY title, company ORDER BY {_SLICE}, ord) AS n FROM scored) WHERE n = 1""")
def stream_scores(spark, d):
    source, texts = listings(spark, d, text_id=True).drop("source", "url"), bodies(spark, d, RULES)
    out, checkpoint = scratch_path(spark, "scores"), scratch_path(spark, "checkpoint")
    score = lambda stream: jobs.score_arrivals(stream, _profile(spark, d), RULES, as_of(), out, checkpoint, body="body", bodies=texts)
    in_slices(source, _by_date(), score)
    return _read(source, out).select("title", "company", "score")


_TIMES = ["1996-01-01", "1998-01-01", "2000-01-01"]


@query("stream_first_seen", f"""WITH {LISTINGS_SQL}, k AS (SELECT DISTINCT {_SLICE} AS slice, {sql_fingerprint()} AS content_key FROM listings WHERE NOT ({_SLICE} = 2 AND ord % 10 = 0))
SELECT content_key, slice FROM k WHERE slice = 0
UNION ALL SELECT content_key, slice FROM k WHERE slice = 1 AND content_key NOT IN (SELECT content_key FROM k WHERE slice = 0)
UNION ALL SELECT content_key, slice FROM k WHERE slice = 2 AND content_key NOT IN (
  SELECT content_key FROM k WHERE slice = 1 AND content_key NOT IN (SELECT content_key FROM k WHERE slice = 0))""")
def stream_first_seen(spark, d):
    """Rows of a slice arrive at one event time, two years apart, with a watermark of 300
    days: what the first slice showed has expired when the third comes, what the second
    showed has not. A tenth of the last slice comes years late and is dropped."""
    rows = listings(spark, d, description=False)
    first, second = _by_date()
    slice_ = F.when(first, 0).when(second, 1).otherwise(2)
    late = (slice_ == 2) & (F.col("ord") % 10 == 0)
    time = F.when(late, F.lit("1990-01-01")).otherwise(F.element_at(F.array(*map(F.lit, _TIMES)), slice_ + 1))
    source = rows.withColumn("slice_no", slice_).withColumn("posted_at", time.cast("timestamp"))
    out, checkpoint = scratch_path(spark, "first"), scratch_path(spark, "checkpoint")
    in_slices(source, _by_date(), lambda stream: jobs.write_append(jobs.first_seen_stream(stream, "posted_at", "300 days"), out, checkpoint))
    return _read(source, out).select("content_key", F.col("slice_no").alias("slice"))


_EVENT_CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


@query("stream_daily", """SELECT * FROM (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_daily(spark, d):
    """Days that the watermark has closed."""
    source = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    cuts = [F.col("ts") < F.lit(c).cast("timestamp") for c in _EVENT_CUTS]
    out, checkpoint = scratch_path(spark, "daily"), scratch_path(spark, "checkpoint")
    in_slices(source, cuts, lambda stream: jobs.write_append(jobs.daily_counts(stream, "ts", "event_type"), out, checkpoint))
    return _read(source, out).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("stream_health", f"{_STREAKS} SELECT source, run_ts, jobs_found, consecutive_zero, consecutive_zero < 3 AS healthy FROM st")
def stream_health(spark, d):
    source = runs(spark, d)
    cuts = [F.col("run_ts") < F.lit(c).cast("timestamp_ntz") for c in _EVENT_CUTS]
    out, checkpoint = scratch_path(spark, "health"), scratch_path(spark, "checkpoint")
    in_slices(source, cuts, lambda stream: jobs.health(stream, out, checkpoint))
    return _read(source, out)


@query("stream_until_target", f"""{SCORED}, o AS (SELECT ord, score, {_SLICE} * 1000000000000 + ord AS k FROM scored),
cut AS (SELECT CASE WHEN count(*) >= 60 THEN max(k) END AS c FROM (SELECT k FROM o WHERE score >= {MIN_SCORE} ORDER BY k LIMIT 60))
SELECT ord, score FROM o, cut WHERE k <= coalesce(c, k)""")
def stream_until_target(spark, d):
    source = _scored(spark, d).select("ord", "posted", "score")
    out, checkpoint = scratch_path(spark, "target"), scratch_path(spark, "checkpoint")
    in_slices(source, _by_date(), lambda stream: jobs.until_target(stream, 60, MIN_SCORE, out, checkpoint))
    return _read(source, out).select("ord", "score")
