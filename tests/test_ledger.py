"""The key ledger: what it knows, what it reads and what a repeated batch finds."""

import random

import pytest
from pyspark.sql import functions as F

from listingflow.sources.ledger import Ledger, cover, key_digest, merges, without_known


def keys(spark, numbers):
    return spark.createDataFrame([(str(n),) for n in numbers], "n string").select(key_digest("n", "n").alias("key"))


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_runs_cover_all_earlier_batches_once(fan_in):
    there = set()
    for batch in range(200):
        for run, parts in merges(batch, fan_in):
            assert all(p in there for p in parts)
            there -= set(parts)
            there.add(run)
        assert sorted(there) == sorted(cover(batch, fan_in))
        held = [b for level, start in cover(batch, fan_in) for b in range(start, start + fan_in**level)]
        assert held == list(range(batch))
        there.add((0, batch))


def test_known_equals_a_set_also_for_a_repeated_batch(spark, tmp_path):
    rng = random.Random(4)
    ledger = Ledger(spark, str(tmp_path), fan_in=2, keys_per_bucket=20)
    seen = set()
    for batch in range(9):
        mine = [rng.randrange(300) for _ in range(40)]
        for _ in range(2):  # the second time is a repeat after a failure before the commit
            old = ledger.known(keys(spark, mine), batch)
            expected = {bytes(r["key"]) for r in keys(spark, sorted(seen & set(mine))).collect()} if seen & set(mine) else set()
            assert {bytes(r["key"]) for r in old.collect()} == expected
            ledger.add(keys(spark, mine), batch)
        seen |= set(mine)


def test_empty_batches_and_null_keys(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), fan_in=2)
    ledger.add(keys(spark, [1]).limit(0), 0)
    assert ledger.known(keys(spark, [1]), 1).count() == 0
    ledger.add(keys(spark, [1]), 1)
    rows = spark.createDataFrame([(0, "1"), (1, None), (2, "2")], "ord long, n string")
    fresh = without_known(rows, [F.when(F.col("n").isNotNull(), key_digest("n", "n"))], ledger, 2)
    assert sorted(r["ord"] for r in fresh.collect()) == [1, 2]


def test_bytes_read_do_not_grow_with_the_store(spark, tmp_path):
    """Batches of a few keys against a store that grows: a look-up reads the buckets of its
    keys in a few runs, not the store."""
    ledger = Ledger(spark, str(tmp_path), fan_in=4, keys_per_bucket=64)
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    read, whole = {}, {}
    for batch in range(17):
        if batch in (4, 16):
            few = keys(spark, [batch * 1000, batch * 1000 + 1])
            looked_up = ledger.lookups(few, batch)
            read[batch] = sum(
                size(tmp_path / f"level={level}" / f"start={start}" / f"bits={bits}" / f"_bucket={b}")
                for (level, start), bits, buckets in looked_up for b in buckets
            )
            whole[batch] = size(tmp_path)
            plan = ledger.known(few, batch)._jdf.queryExecution().executedPlan().toString()
            assert len(looked_up) == 1 and "PartitionFilters: [_bucket" in plan
        else:
            ledger.lookups(keys(spark, [0]), batch)
        ledger.add(keys(spark, range(batch * 1000, batch * 1000 + 250)), batch)
    assert whole[16] > 3.5 * whole[4]
    assert 0 < read[16] <= 1.5 * read[4] and read[16] < whole[16] / 10
