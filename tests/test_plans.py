"""Shapes of physical plans."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from listingflow.operators import health, keys, search, topk
from listingflow.plans.driver_tables import bodies, listings, search_rows
from listingflow.plans.queries_listings import RULES
from listingflow.streaming import jobs

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


OWN = [n for n, q in entry_points.queries().items() if q.__module__.startswith("listingflow.plans")]
PYTHON = re.compile("PythonUDF|EvalPython|MapInPandas|MapInArrow|FlatMapGroups|FlatMapCoGroups")


@pytest.mark.parametrize("name", OWN)
def test_no_nested_loop_cartesian_join_or_python(spark, name):
    text = plan(entry_points.queries()[name](spark, DIR))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    assert not PYTHON.search(text)


def test_package_has_no_python_in_tasks():
    """Also plans inside materialised steps and micro-batches have none."""
    root = Path(__file__).resolve().parents[1] / "listingflow"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"mapIn|applyIn|pandas_udf|@F\.udf|F\.udf\(|\.rdd\b|tempfile", path.read_text()), path


def test_a_small_batch_does_not_shuffle_its_store(spark):
    store = spark.range(1000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("ord"))
    # The size of files, as of a range, is known when the plan is made.
    batch = spark.range(990, 1010, numPartitions=1).select(F.col("id").cast("string").alias("k"), F.col("id").alias("ord"))
    fresh = keys.anti_join(batch, store, ["k"], small_left=True)
    text = plan(fresh)
    semi = text.index("LeftSemi")
    scan = text.index("Range (0, 1000", semi)
    assert "BroadcastHashJoin" in text[:semi] and "Exchange hashpartitioning" not in text[semi:scan]
    assert sorted(r["ord"] for r in fresh.collect()) == list(range(1000, 1010))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(listings(spark, DIR, description=False).select("ord", "company"))
    assert "o_totalprice" not in text and "documents.parquet" not in text
    rows = plan(search_rows(spark, DIR).where("source = 'view'").select("task"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in rows


def test_prefix_and_top_use_no_global_window(spark):
    df = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 7).cast("double").alias("score"))
    assert "Window" not in plan(topk.prefix_until(df, 3, 5.0))
    assert "TakeOrderedAndProject" in plan(topk.top_n(df, 5))
    grouped = df.withColumn("g", F.col("ord") % 3)
    assert "WindowGroupLimit" in plan(topk.top_per_group(grouped, ["g"], 2))


def test_minimum_per_key_is_combined_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("k"))
    text = plan(keys.first_per_key(df, ["k"]))
    assert "partial_min" in text and "Window" not in text


def test_streaks_read_their_input_once(spark):
    """What is left after the one pass reads the written streaks alone."""
    runs = spark.range(50).select(
        F.lit("a").alias("source"), F.timestamp_seconds("id").alias("run_ts"), (F.col("id") % 3).alias("jobs_found")
    )
    text = plan(health.zero_streaks(runs, block_seconds=10))
    assert "Range (" not in text and "streaks-" in text


def test_a_store_is_not_read_by_a_batch(spark, tmp_path):
    """A batch of a stream knows what the store has from the ledger beside it."""
    schema = "ord long, title string, company string, location string, job_id string"
    for i in range(3):
        rows = [(i * 10 + k, f"t{(i * 10 + k) % 17}", "c", "l", str((i * 10 + k) % 13)) for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
    stream = jobs.file_stream(spark, str(tmp_path / "landed"), spark.createDataFrame([], schema).schema, 1)
    jobs.ingest(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"))
    stored = spark.read.parquet(str(tmp_path / "store")).collect()
    assert len({r["job_id"] for r in stored}) == len(stored) == 13
    held = sorted(p.name for p in (tmp_path / "store-keys" / "level=0").iterdir())
    assert held == ["start=0", "start=1", "start=2"]


def test_task_grid_is_narrow(spark):
    grid = search.task_grid(spark.range(3).withColumnRenamed("id", "keyword_ord"), [("a", "b"), ("c", "d")])
    assert "Exchange" not in plan(grid)


def test_long_texts_of_one_row_group_are_searched_by_many_tasks(spark, tmp_path):
    """A table of texts may be one row group, which one task reads."""
    digits = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f" {i}")), 256) for i in range(64)])
    texts = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(digits, F.lit(" the ring")).alias("text"))
    texts.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = bodies(spark, str(tmp_path), RULES)
    assert len(found.inputFiles()) > 1
    assert found.count() == found.where(found["body"]["roles"][0]).select("doc_id").distinct().count() == 2000


@pytest.mark.parametrize("kind", [{"rules": RULES}, {"text_id": True}])
def test_listings_that_are_scored_are_dealt_to_tasks(spark, kind):
    """Also where their table is one row group and all joins are broadcast."""
    tasks = listings(spark, DIR, **kind).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < sum(r["count"] for r in tasks) / 2
