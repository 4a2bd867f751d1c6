"""Aggregates over fetch logs, phases, outcomes and listings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.score import two_decimals
from listingflow.scratch import materialize_observed


def exact_sum(c: str) -> Column:
    """Sum that does not depend on the order of rows: decimals are exact."""
    return F.sum(F.col(c).cast("decimal(28,6)"))


def mean(c: str) -> Column:
    return exact_sum(c).cast("double") / F.count(c)


def fetch_stats(log: DataFrame) -> DataFrame:
    """Per-source statistics of a fetch log with one row per fetched page.

    A page counts as read only if it came and had rows; a failed fetch has none. The
    average duration is that of a search, all pages of one task.
    """
    came = ~F.coalesce("failed", F.lit(False))
    of = lambda c: F.sum(F.when(came, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)))
    return log.groupBy("source").agg(
        F.count_distinct("task").alias("queries"),
        F.count_if(came & (F.col("rows") > 0)).alias("pages_scraped"),
        (of("rows") - of("dups")).cast("long").alias("jobs_found"),
        of("dups").cast("long").alias("duplicates"),
        F.count_if("failed").alias("failed_requests"),
        F.count_if("early_stopped").alias("early_stopped"),
        F.coalesce(two_decimals(exact_sum("duration").cast("double")), F.lit(0.0)).alias("total_duration"),
        F.coalesce(
            two_decimals(exact_sum("duration").cast("double") / F.nullif(F.count_distinct("task"), F.lit(0))), F.lit(0.0)
        ).alias("avg_duration"),
    )


def phase_share(phases: DataFrame) -> DataFrame:
    """Seconds of each phase and its share of the total in percent.

    Phases are aggregated first; the total is a scalar over those few rows.
    """
    per_phase = phases.groupBy("phase").agg(exact_sum("seconds").alias("_sum"))
    total = phases.agg(exact_sum("seconds").cast("double").alias("t")).scalar()
    seconds = F.col("_sum").cast("double")
    return per_phase.select(
        "phase",
        two_decimals(seconds).alias("seconds"),
        F.when(total > 0, two_decimals(seconds / total * 100)).otherwise(F.lit(0.0)).alias("percent"),
    )


def counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("key").agg(F.sum("n").cast("long").alias("total"))


def value_averages(values: DataFrame) -> DataFrame:
    return values.groupBy("key").agg(
        two_decimals(mean("value")).alias("average"), F.count("value").alias("n")
    )


def outcome_counts(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    return rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def daily_trend(listings: DataFrame, as_of: Column, posted: str = "posted") -> DataFrame:
    """Listings per day, in order of days; a missing date counts for the day of the run."""
    return (
        listings.groupBy(F.coalesce(F.col(posted), as_of).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("day")
    )


def category_counts(listings: DataFrame, category: str = "category") -> DataFrame:
    return (
        listings.groupBy(F.coalesce(F.col(category), F.lit("Unknown")).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("name"))
    )


def written_scores(scored: DataFrame, min_score: float) -> tuple[DataFrame, dict[str, object]]:
    """The scored rows, written, and what a run reports of them, taken as they are written:
    ``total_scored``, ``recommended`` and ``avg_score`` of the recommended."""
    best = F.col("score") >= min_score
    exact = F.sum(F.when(best, F.col("score").cast("decimal(28,6)")))
    table, seen = materialize_observed(
        scored, "scored", total_scored=F.count(F.lit(1)), recommended=F.count_if(best), total=exact
    )
    n, total = seen["recommended"], seen.pop("total")
    return table, {**seen, "avg_score": math.floor(float(total) / n * 100 + 0.5) / 100 if n else None}


def observed_totals(counts: dict[str, object], scraped: DataFrame, progress: DataFrame, as_of: Column) -> DataFrame:
    """``run_totals`` with the figures of the scored rows from ``written_scores``."""
    rows = scraped.select(F.lit(False).alias("done")).unionAll(progress.where("status = 'done'").select(F.lit(True)))
    return rows.agg(
        F.count_if(~F.col("done")).alias("total_scraped"), F.count_if("done").alias("total_applied")
    ).select(
        as_of.alias("date"), "total_scraped", F.lit(counts["total_scored"]).cast("long").alias("total_scored"),
        F.lit(counts["recommended"]).cast("long").alias("recommended"), "total_applied",
        F.lit(counts["avg_score"]).cast("double").alias("avg_score"),
    )


def run_totals(
    scraped: DataFrame, scored: DataFrame, recommended: DataFrame, progress: DataFrame,
    as_of: Column,
) -> DataFrame:
    """One row for the run. The four counts are taken in one aggregation over
    tagged rows, so no input is joined with another."""

    def tag(df: DataFrame, kind: str, score: Column, done: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), score.alias("score"), done.alias("done"))

    none, no = F.lit(None).cast("double"), F.lit(False)
    rows = (
        tag(scraped, "scraped", none, no)
        .unionAll(tag(scored, "scored", none, no))
        .unionAll(tag(recommended, "recommended", F.col("score").cast("double"), no))
        .unionAll(tag(progress, "progress", none, F.col("status") == "done"))
    )
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.agg(
        n("scraped").alias("total_scraped"),
        n("scored").alias("total_scored"),
        n("recommended").alias("recommended"),
        F.count_if("done").alias("total_applied"),
        two_decimals(mean("score")).alias("avg_score"),
    ).select(as_of.alias("date"), "*")
