"""Runs that end early and go on."""

import pytest
from pyspark.sql import functions as F

from listingflow.defaults import SCORE_RULES
from listingflow.operators.scoring import text_bodies
from listingflow.plans.staged import Stages, Stopped, content_id, staged_run

SCHEMA = "ord long, title string, company string, category string, location string, posted string, description string, url string"
ROWS = [
    (i, ["Data Analyst", "Cook", "Engineer"][i % 3], f"c{i % 5}", "data_analyst", "Remote", "2024-01-10", "sql python 2 years", f"u{i % 7}")
    for i in range(40)
]
CV = "Data Analyst, sql python excel. 4+ years of experience in analytics"


def go(spark, path, rows=ROWS, **kw):
    df, profile = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(CV,)], "text string")
    return staged_run(df, profile, SCORE_RULES, F.lit("2024-01-10").cast("date"), str(path), ("c3",), 3.0, 5, **kw)


@pytest.mark.parametrize("last", ["unique", "kept", "scored"])
def test_a_run_goes_on_after_its_last_stage(spark, tmp_path, last):
    names = ["unique", "kept", "scored", "recommended"]
    with pytest.raises(Stopped):
        go(spark, tmp_path / "a", stop_after=last)
    best, stages = go(spark, tmp_path / "a")
    at = names.index(last) + 1
    assert (stages.done, stages.made) == (names[:at], names[at:])
    whole, _ = go(spark, tmp_path / "b")
    order = lambda df: [tuple(r) for r in df.orderBy("rank").collect()]
    assert order(best) == order(whole) and best.count() > 0


def test_a_half_written_stage_is_made_again(spark, tmp_path):
    _, first = go(spark, tmp_path)
    (tmp_path / first.folder("scored").rsplit("/", 1)[1] / "_SUCCESS").unlink()
    best, second = go(spark, tmp_path)
    assert second.made == ["scored"] and second.done == ["unique", "kept", "recommended"]
    assert best.count() == 5


def test_other_inputs_and_parameters_are_other_runs(spark, tmp_path):
    go(spark, tmp_path)
    _, changed = go(spark, tmp_path, rows=ROWS[:-1])
    assert changed.done == []
    df, profile = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(CV,)], "text string")
    _, fewer = staged_run(df, profile, SCORE_RULES, F.lit("2024-01-10").cast("date"), str(tmp_path), ("c3",), 3.0, 4)
    assert fewer.made == ["recommended"]


def test_content_ids(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a long, b string")
    assert content_id(a) == content_id(a.repartition(3).select("b", "a"))
    assert len({content_id(d) for d in (a, a.limit(2), a.fillna(""), a.withColumnRenamed("a", "c"), a.limit(0))}) == 5


def test_a_stage_without_inputs_of_its_own_reads_the_runs(spark, tmp_path):
    one, two = (Stages(spark, str(tmp_path), [i]) for i in "ab")
    for s in (one, two):
        s.stage("x", lambda: spark.range(2))
    assert one.folder("x") != two.folder("x") and one.made == two.made == ["x"]


def test_bodies_are_joined_to_kept_listings(spark, tmp_path):
    """Up to the scores a listing has the number of its text; the outcome is that of whole texts."""
    texts = spark.createDataFrame([(0, "sql python"), (1, "excel 2 years"), (2, None)], "doc_id long, text string")
    df = spark.createDataFrame(ROWS, SCHEMA).drop("description").withColumn("doc_id", F.col("ord") % 3).withColumn("note", F.lit("3+ years"))
    profile = spark.createDataFrame([(CV,)], "text string")
    args = (profile, SCORE_RULES, F.lit("2024-01-10").cast("date"))
    bodies = text_bodies(texts, SCORE_RULES)
    best, stages = staged_run(df, *args, str(tmp_path / "a"), ("c3",), 3.0, 5, body="body", bodies=bodies)
    kept = spark.read.parquet(stages.folder("kept"))
    assert "doc_id" in kept.columns and "body" not in kept.columns and "doc_id" not in best.columns
    whole = df.join(texts, "doc_id").withColumn("description", F.concat("text", F.lit(" "), "note")).drop("doc_id", "text", "note")
    expected, _ = staged_run(whole, *args, str(tmp_path / "b"), ("c3",), 3.0, 5)
    rows = lambda df: df.select("rank", "ord", "score", "reason").orderBy("rank").collect()
    assert rows(best) == rows(expected) and len(rows(best)) == 5
    _, other = staged_run(df, *args, str(tmp_path / "a"), ("c3",), 3.0, 5, body="body", bodies=bodies.where("doc_id < 2"))
    assert other.done == []
