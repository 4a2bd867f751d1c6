"""Streaming jobs. Each batch job has a batch twin among the operators.

Jobs that need more than one key or an order use ``foreachBatch``: each micro-batch
is an ordinary distributed job. What a batch adds goes to a folder named after the
batch id and is overwritten on replay, so a repeated batch adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.defaults import ZERO_RUNS_UNHEALTHY
from listingflow.functions.score import ScoreRules
from listingflow.functions.text import content_fingerprint
from listingflow.operators.health import zero_streaks
from listingflow.operators.keys import first_per_key, pick_rows
from listingflow.operators.merge import drop_private, first_of_batch
from listingflow.operators.scoring import score_entries, score_listings
from listingflow.operators.topk import prefix_until
from listingflow.sources.ledger import Ledger, key_digest, without_known
from listingflow.sources.stores import read_store

BATCH = "_batch"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Landed parquet files: all that are there in one micro-batch, or a bounded number."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def earlier_batches(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of the store that earlier batches wrote; pruned by folder."""
    full = T.StructType(schema.fields + [T.StructField(BATCH, T.LongType())])
    return read_store(spark, path, full).where(F.col(BATCH) < batch_id).drop(BATCH)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest(stream: DataFrame, store: str, checkpoint: str, id_col: str = "job_id", content: Sequence[str] = ("title", "company", "location")) -> None:
    """Merge only-new listings of each micro-batch into the store.

    What the store has is known from a ledger of keys beside it, of which a batch reads the
    buckets that its own keys fall in; the store itself is never read.
    """
    schema = T.StructType([f for f in stream.schema.fields if not f.name.startswith("_")])
    blank = F.coalesce(F.col(id_col).cast("string"), F.lit("")) == ""
    keys = [F.when(~blank, key_digest("id", id_col)), key_digest("content", *content)]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, f"{store}-keys")
        fresh = without_known(batch.select("ord", id_col, *content), keys, ledger, batch_id)
        write_batch(pick_rows(drop_private(batch), first_of_batch(fresh, id_col, content)), store, batch_id)
        _add_written(spark, store, schema, keys, ledger, batch_id)

    run_available(stream, each, checkpoint)


def _add_written(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[Column], ledger: Ledger, batch_id: int) -> None:
    written = read_store(spark, f"{store}/{BATCH}={batch_id}", schema)
    ledger.add(written.select(F.explode(F.array_compact(F.array(*keys))).alias("key")), batch_id)


def score_arrivals(stream: DataFrame, profile: DataFrame, rules: ScoreRules, as_of: Column, cache: str, checkpoint: str, posted: str = "posted", body: str | None = None, bodies: DataFrame | None = None, text_id: str = "doc_id") -> None:
    """Score each new (title, company) once, in arrival order across batches. Which pairs
    have a score is known from a ledger of keys beside the cache. ``body`` is that of
    ``score_listings``; with ``bodies``, of which each ``text_id`` has its ``body``, the
    listings carry the ``text_id`` alone."""
    pair = T.StructType.fromDDL("title string, company string")
    keys = [key_digest("pair", "title", "company")]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger = Ledger(spark, f"{cache}-keys")
        # Pairs and numbers decide; whole rows are moved once.
        firsts = first_per_key(without_known(batch.select("ord", *pair.fieldNames()), keys, ledger, batch_id), pair.fieldNames())
        fresh = pick_rows(batch, firsts)
        if bodies is not None:
            fresh = fresh.join(bodies, text_id).drop(text_id)
        write_batch(score_entries(score_listings(fresh, profile, rules, as_of, posted=posted, body=body)), cache, batch_id)
        _add_written(spark, cache, pair, keys, ledger, batch_id)

    run_available(stream, each, checkpoint)


def first_seen_stream(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Drop rows whose content was seen within the watermark. State is one key per
    content and expires; exact two-key dedup over all time is ``ingest``."""
    keyed = stream.withColumn("content_key", content_fingerprint("company", "title", "location"))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_key"])


def daily_counts(stream: DataFrame, ts: str, group: str, delay: str = "1 day") -> DataFrame:
    """Rows per day and group; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), group)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w")["start"].alias("day"), group, "n")
    )


def write_append(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run an append-mode stream over what is there into a parquet table."""
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def health(stream: DataFrame, out: str, checkpoint: str, unhealthy_at: int = ZERO_RUNS_UNHEALTHY) -> None:
    """Streak of zero runs per source, carried from batch to batch.

    Runs of later batches must not be older than those of earlier ones. Each batch
    finds its streaks with the distributed operator; the streak a source ended with
    is added to the runs before its first hit in the new batch. That state, one row per
    source, is written beside the output; a batch reads only the state of the one before.
    """
    schema = T.StructType(
        stream.schema.fields
        + [T.StructField("consecutive_zero", T.LongType()), T.StructField("healthy", T.BooleanType())]
    )

    state = f"{out}-state"
    state_schema = T.StructType(
        [f for f in stream.schema.fields if f.name == "source"]
        + [T.StructField("_carry", T.LongType()), T.StructField(BATCH, T.LongType())]
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        before = read_store(batch.sparkSession, state, state_schema).where(F.col(BATCH) == batch_id - 1)
        last = before.select("source", "_carry")
        hits = batch.where(F.col("jobs_found") > 0).groupBy("source").agg(F.min("run_ts").alias("_first_hit"))
        local = zero_streaks(batch, unhealthy_at=unhealthy_at)
        open_run = F.col("_first_hit").isNull() | (F.col("run_ts") < F.col("_first_hit"))
        streak = F.col("consecutive_zero") + F.when(open_run, F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
        joined = local.join(last, "source", "left").join(hits, "source", "left")
        write_batch(
            joined.withColumn("consecutive_zero", streak)
            .withColumn("healthy", F.col("consecutive_zero") < unhealthy_at)
            .select(*schema.fieldNames()),
            out, batch_id,
        )
        ended = (
            read_store(batch.sparkSession, out, T.StructType(schema.fields + [T.StructField(BATCH, T.LongType())]))
            .where(F.col(BATCH) == batch_id)
            .groupBy("source")
            .agg(F.max_by("consecutive_zero", "run_ts").alias("_now"))
        )
        write_batch(
            last.join(ended, "source", "full").select("source", F.coalesce("_now", "_carry").alias("_carry")), state, batch_id
        )

    run_available(stream, each, checkpoint)


def until_target(stream: DataFrame, target: int, threshold: float, out: str, checkpoint: str, score: str = "score") -> None:
    """Keep scored rows in arrival order until ``target`` rows passed; later batches add
    nothing once it is reached."""
    schema = stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        before = earlier_batches(batch.sparkSession, out, schema, batch_id)
        # A count of at most ``target`` rows decides how many are still wanted.
        have = before.where(F.col(score) >= threshold).limit(target).count()
        wanted = target - have
        kept = prefix_until(batch, wanted, threshold, score) if wanted > 0 else batch.where(F.lit(False))
        write_batch(kept, out, batch_id)

    run_available(stream, each, checkpoint)
