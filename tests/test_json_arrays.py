"""JSON arrays in byte ranges against the reader of whole files."""

import json
import random

import pytest

from listingflow.sources.json_arrays import fragments, read_split_array
from listingflow.sources.stores import read_json_array

SCHEMA = "a string, n bigint, o struct<x: string, y: array<struct<z: string>>>"


def rows(n, seed):
    rng = random.Random(seed)
    odd = ['plain', '}', '{', '"', '\\', '\\"}', '}{', '[', ',', 'ü€🙂', 'line\nend', '\\\\', '"}]', ""]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 6)))
    return [
        {"a": text(), "n": i, "o": {"x": text(), "y": [{"z": text()} for _ in range(rng.randint(0, 3))]}} if i % 5 else {"n": i, "a": None}
        for i in range(n)
    ]


def as_set(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_many_ranges_give_the_rows_of_one_reader(spark, tmp_path, indent):
    path = tmp_path / "big.json"
    path.write_text(json.dumps(rows(1500, 3), indent=indent, ensure_ascii=indent is None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert fragments(spark, str(path)).select("start").distinct().count() > 10
        got = as_set(read_split_array(spark, str(path), SCHEMA))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == 1500 and got == as_set(read_json_array(spark, str(path), SCHEMA))


def test_several_files_and_empty_arrays(spark, tmp_path):
    for i, n in enumerate((0, 1, 7)):
        (tmp_path / f"{i}.json").write_text(" \n" + json.dumps(rows(n, i)) + "\n")
    assert as_set(read_split_array(spark, str(tmp_path), SCHEMA)) == as_set(read_json_array(spark, str(tmp_path), SCHEMA))


def test_other_values_at_the_top_are_left_out(spark, tmp_path):
    (tmp_path / "x.json").write_text('[1, "{", null, {"n": 4, "a": "]"}, [2], {"n": 5}]')
    assert [(r["a"], r["n"]) for r in read_split_array(spark, str(tmp_path), SCHEMA).orderBy("n").collect()] == [("]", 4), (None, 5)]
