"""One large JSON array file, read by many tasks.

The file is read in byte ranges, as fragments that end at a closing brace. Whether a
fragment begins inside a string follows from the quotes before it, and how deep it lies in
objects from the braces outside of strings. Both are sums over fragments, so each range sums
up its own, a row for each range carries the sums over range borders, and a second pass
places every fragment: a record ends where the depth is back at nothing. Only the fragments
of one record are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.operators.once import once
from listingflow.scratch import materialize


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, place, text``: the file's parts up to each closing brace, in order of
    the byte range that they were read in and of their place in it."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"),
    )


def _opened(parity: int) -> Column:
    """Opening braces in the parts between quotes that lie outside of strings, where the
    first part is outside (0) or inside (1)."""
    outside = F.filter("_parts", lambda p, i: i % 2 == parity)
    return F.aggregate(outside, F.lit(0), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all earlier fragments of the file."""
    in_range = Window.partitionBy("file", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("file", "start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(in_range), F.lit(0)))
    return own.join(carry, ["file", "start"]).withColumn("before", F.col("_own") + F.col("_carry")).drop("_own", "_carry")


def read_split_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of JSON array files, of which each may be one long line.

    Objects that don't fit the schema give null fields, as ``from_json`` does. What isn't an
    object is left out; one that lies in further arrays is found there. The files must be well-formed JSON: after a string
    that doesn't end, nothing is found in that file.
    """
    # No brace is escaped in JSON, so an escape never reaches over a fragment's end.
    bare = F.regexp_replace("text", r"\\.", "")
    parts = once(fragments(spark, path), {"_parts": F.split(bare, '"')})
    summed = materialize(
        parts.select(
            "file", "start", "place", "text", ((F.size("_parts") - 1) % 2).alias("odd"),
            _opened(0).alias("open_out"), _opened(1).alias("open_in"),
        ),
        "fragments",
    )
    inside = F.col("before") % 2
    after = (inside + F.col("odd")) % 2
    # The brace that ends a fragment closes an object unless it stands in a string.
    step = F.when(inside == 0, F.col("open_out")).otherwise(F.col("open_in")) - F.when(after == 0, 1).otherwise(0)
    quoted = _carried(summed, F.col("odd")).withColumn("step", step).withColumn("closes", after == 0)
    deep = _carried(materialize(quoted.drop("before", "odd", "open_out", "open_in"), "quoted"), F.col("step"))
    ended = F.col("closes") & (F.col("before") + F.col("step") == 0)
    numbered = _carried(
        materialize(deep.withColumn("ends", F.when(ended, 1).otherwise(0)).drop("before", "step", "closes"), "ended"), F.col("ends")
    )
    records = numbered.groupBy("file", F.col("before").alias("record")).agg(
        F.max("ends").alias("whole"), F.sort_array(F.collect_list(F.struct("start", "place", "text"))).alias("found")
    )
    text = F.concat(F.array_join(F.transform("found", lambda f: f["text"]), "}"), F.lit("}"))
    # What stands between objects: brackets, commas, white space, other values, also strings.
    body = F.regexp_replace(text, r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+', "")
    return records.where("whole = 1").select(F.from_json(body, schema).alias("r")).select("r.*")
