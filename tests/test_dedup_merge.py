"""First-seen dedup and merge against a sequential loop, also with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from listingflow.operators import dedup
from listingflow.operators.dedup import _kept_and_read, first_seen, first_seen_counts, kept_ords, listing_keys
from listingflow.operators.keys import anti_join
from listingflow.operators.merge import lookup_latest, merge_new, not_done, unscored

KEYS = lambda: {"a": F.col("k1"), "b": F.col("k2")}


def sequential(rows):
    seen1, seen2, kept = set(), set(), []
    for ord_, k1, k2 in sorted(rows):
        if (k1 is not None and k1 in seen1) or (k2 is not None and k2 in seen2):
            continue
        if k1 is not None:
            seen1.add(k1)
        if k2 is not None:
            seen2.add(k2)
        kept.append(ord_)
    return kept


def run(spark, rows):
    df = spark.createDataFrame(rows, "ord long, k1 string, k2 string")
    return sorted(r[0] for r in kept_ords(df, KEYS()).collect())


def test_second_key_of_a_rejected_row_stays_free(spark):
    rows = [(0, "1", "1"), (1, "2", "1"), (2, "2", "2")]
    assert run(spark, rows) == [0, 2]


@pytest.mark.parametrize("seed,plain", [(1, 2), (2, 0), (3, 99)])
def test_random_rows(spark, monkeypatch, seed, plain):
    monkeypatch.setattr(dedup, "PLAIN_ROUNDS", plain)
    rnd = random.Random(seed)
    pick = lambda n: None if rnd.random() < 0.1 else str(rnd.randrange(n))
    rows = [(i, pick(60), pick(70)) for i in range(400)]
    rnd.shuffle(rows)
    assert run(spark, rows) == sequential(rows)


def test_hot_keys_and_copies(spark):
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else str(rnd.randrange(900)), "copy" if i % 3 == 1 else str(i)) for i in range(6000)]
    assert run(spark, rows) == sequential(rows)


def test_long_chain_is_finished_exactly(spark):
    # Each row shares one key with the row before it, in turn.
    rows = [(i, str((i + 1) // 2), str(i // 2)) for i in range(25_000)]
    assert run(spark, rows) == sequential(rows)


def test_chains_that_meet_and_branch(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PLAIN_ROUNDS", 0)
    rnd = random.Random(3)
    rows = [(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(60)]
    rows += [(60 + i, f"a{rnd.randrange(40)}", f"b{rnd.randrange(40)}") for i in range(60)]
    rnd.shuffle(rows)
    rows = [(i, a, b) for i, (_, a, b) in enumerate(rows)]
    assert run(spark, rows) == sequential(rows)


def test_a_key_that_looks_like_a_stand_in_is_only_a_key(spark):
    rows = [(0, "x", None), (1, "y", "ord:0"), (2, "z", "o:0"), (3, "w", "v:")]
    assert run(spark, rows) == [0, 1, 2, 3]


def test_blank_content_is_a_key_and_blank_url_is_not(spark):
    rows = [(0, "", "", "", ""), (1, " ", "", "", ""), (2, "A", "B", "C", ""), (3, "A!", "b", " c", ""), (4, "D", "E", "F", "x.y/z"), (5, "G", "H", "I", "xyz")]
    df = spark.createDataFrame(rows, "ord long, company string, title string, location string, url string")
    assert sorted(r["ord"] for r in first_seen(df, listing_keys()).collect()) == [0, 2, 4]
    counts = first_seen_counts(df).first()
    assert (counts["total"], counts["kept"], counts["duplicates"]) == (6, 3, 3)


def listing_rows(n, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["", str(rnd.randrange(n // 3))]), f"t{rnd.randrange(9)}", f"c{rnd.randrange(9)}", f"l{rnd.randrange(4)}", 1) for i in range(n)]


SCHEMA = "ord long, job_id string, title string, company string, location string, _note int"


def test_merge_adds_only_new_and_second_merge_adds_none(spark):
    batch = spark.createDataFrame(listing_rows(300, 1), SCHEMA)
    store = spark.createDataFrame(listing_rows(60, 2), SCHEMA).drop("_note")
    added = merge_new(store, batch)
    assert "_note" not in added.columns
    stored = store.collect()
    ids, content = {r["job_id"] for r in stored if r["job_id"]}, {(r["title"], r["company"], r["location"]) for r in stored}
    expected = []
    for r in sorted(batch.collect(), key=lambda r: r["ord"]):
        key = (r["title"], r["company"], r["location"])
        if (r["job_id"] and r["job_id"] in ids) or key in content:
            continue
        content.add(key)
        if r["job_id"]:
            ids.add(r["job_id"])
        expected.append(r["ord"])
    assert sorted(r["ord"] for r in added.collect()) == expected
    assert merge_new(store.unionByName(added), batch).count() == 0


def test_unscored_lookup_and_progress(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "ord long, title string, company string")
    cache = spark.createDataFrame([("b", "y"), ("b", "y")], "title string, company string")
    assert [r["ord"] for r in unscored(rows, cache).orderBy("ord").collect()] == [0, 1, 3]
    assert [r["ord"] for r in unscored(rows, cache, dedup_in_batch=True).orderBy("ord").collect()] == [0, 3]
    store = spark.createDataFrame([(5, "a", "x", "old"), (9, "a", "x", "new")], "ord long, title string, company string, url string")
    found = {r["ord"]: (r["store_url"], r["found"]) for r in lookup_latest(rows, store).collect()}
    assert found == {0: ("new", True), 1: ("new", True), 2: (None, False), 3: (None, False)}
    jobs = spark.createDataFrame([("p",), ("q",), ("r",)], "job_key string")
    progress = spark.createDataFrame([("p", "done"), ("q", "reused")], "job_key string, status string")
    assert sorted(r[0] for r in not_done(jobs, progress).collect()) == ["q", "r"]


def test_hot_left_key_is_split(spark):
    """A third of the left rows share one key: adaptive execution splits it."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(90_000, numPartitions=8).select(
            F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
        right = spark.range(0, 90_000, 7, numPartitions=4).select(F.col("id").cast("string").alias("k"))
        joined = anti_join(left, right, ["k"])
        rows = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        dropped = {i for i in range(0, 90_000, 7) if i % 3}
        assert len(rows) == 90_000 - len(dropped)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_rounds_move_sixteen_bytes_of_a_key(spark):
    """Keys may be long texts; a missing one has a stand-in of the same size."""
    df = spark.createDataFrame([(0, "a" * 500, None), (1, "a" * 500, "x"), (2, "b", "x"), (3, None, "o:1")], "ord long, k1 string, k2 string")
    kept, start = _kept_and_read(df, {"k1": F.col("k1"), "k2": F.col("k2")}, "ord")
    sizes = start.select(F.length("k1"), F.length("k2")).collect()
    assert len(sizes) == 4 and {n for row in sizes for n in row} == {16}
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 3]
