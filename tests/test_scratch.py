"""Where intermediate tables go, and that they go away."""

import os

import pytest

from pyspark.sql import functions as F

from listingflow.operators import stats
from listingflow.operators.filters import written_split
from listingflow.scratch import default_root, discard, materialize, scratch_path, scratch_root


def test_the_configured_folder_is_used(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_without_a_setting_the_default_file_system_is_used():
    assert default_root("hdfs://names:8020/", "yarn").startswith("hdfs://names:8020/")
    assert default_root("file:///", "local[8]").startswith("/")


def test_a_local_disk_of_a_cluster_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            default_root("file:///", master)


def test_discarded_tables_are_deleted(spark):
    frame = materialize(spark.range(5), "gone")
    path = frame._scratch_path
    assert frame.count() == 5 and os.path.isdir(path)
    discard(frame, spark.range(1))
    assert not os.path.exists(path)


def test_observed_figures_take_no_job_of_their_own(spark):
    """The jobs of a write with figures are those of the write alone."""
    rows = spark.range(1000, numPartitions=3).select(F.col("id").alias("ord"), (F.col("id") % 10).cast("double").alias("score"))
    context = spark.sparkContext

    def jobs(name, run):
        context.setJobGroup(name, name)
        try:
            return run(), len(context.statusTracker().getJobIdsForGroup(name))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    _, plain = jobs("plain", lambda: materialize(rows, "plain"))
    (table, counts), observed = jobs("observed", lambda: stats.written_scores(rows, 7.0))
    assert observed == plain
    assert counts == {"total_scored": 1000, "recommended": 300, "avg_score": 8.0} and table.count() == 1000
    assert stats.written_scores(rows.limit(0), 7.0)[1] == {"total_scored": 0, "recommended": 0, "avg_score": None}


def test_a_written_split_counts_both_sides(spark):
    df = spark.createDataFrame([("a", None), ("b", "why"), ("c", None)], "company string, rejection_reason string")
    kept, rejected, counts = written_split(df)
    assert counts == {"kept": 2, "rejected": 1} and kept.columns == ["company"]
    assert sorted(r[0] for r in kept.collect()) == ["a", "c"] and [tuple(r) for r in rejected.collect()] == [("b", "why")]
