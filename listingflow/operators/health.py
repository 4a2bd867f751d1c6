"""Source health: streaks of runs that found nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.defaults import ZERO_RUNS_UNHEALTHY
from listingflow.scratch import materialize


def zero_streaks(
    runs: DataFrame,
    source: str = "source",
    run_ts: str = "run_ts",
    found: str = "jobs_found",
    unhealthy_at: int = ZERO_RUNS_UNHEALTHY,
    block_seconds: int = 86_400,
) -> DataFrame:
    """For every run the number of zero runs in a row up to it, and the health flag.

    The history of one source is never sorted in one task. It is cut into time blocks, each
    of which counts its own streaks, in one pass over ``runs`` whose result is written. A
    block is summed up by whether any of its runs found something and by the streak at its
    end; one row per block then carries streaks over block borders.
    """
    block = F.floor(F.unix_micros(F.col(run_ts).cast("timestamp")) / (block_seconds * 1_000_000))
    rows = runs.withColumn("_block", block).withColumn("_zero", (F.col(found) == 0).cast("long"))
    in_block = Window.partitionBy(source, "_block").orderBy(run_ts)
    marked = rows.withColumn("_island", F.sum(1 - F.col("_zero")).over(in_block))
    island = Window.partitionBy(source, "_block", "_island").orderBy(run_ts)
    local = materialize(marked.withColumn("_streak", F.sum("_zero").over(island)), "streaks")

    summary = local.groupBy(source, "_block").agg(
        F.coalesce(F.max(1 - F.col("_zero")), F.lit(0)).alias("_hit"),
        F.coalesce(F.max_by("_streak", run_ts), F.lit(0)).alias("_tail"),
    )
    over_blocks = Window.partitionBy(source).orderBy("_block")
    carried = (
        summary.withColumn("_run", F.sum("_hit").over(over_blocks))
        .withColumn("_end", F.sum("_tail").over(Window.partitionBy(source, "_run").orderBy("_block")))
        .withColumn("_carry", F.coalesce(F.lag("_end").over(over_blocks), F.lit(0)))
        .select(source, "_block", "_carry")
    )
    streak = F.col("_streak") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(F.lit(0))
    return (
        local.join(carried, [source, "_block"])
        .withColumn("consecutive_zero", streak)
        .withColumn("healthy", F.col("consecutive_zero") < unhealthy_at)
        .select(*runs.columns, "consecutive_zero", "healthy")
    )


def current_health(streaks: DataFrame, source: str = "source", run_ts: str = "run_ts") -> DataFrame:
    """State after the last run of each source."""
    state = [run_ts, "jobs_found", "consecutive_zero", "healthy"]
    last = streaks.groupBy(source).agg(F.max(F.struct(*state)).alias("s"))
    return last.select(source, *[F.col("s")[c].alias("last_run" if c == run_ts else c) for c in state])
