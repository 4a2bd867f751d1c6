"""Connected components by alternating star contraction, as equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.scratch import discard, materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs(u, v)`` with the smallest ``v`` of each ``u`` as ``m``.

    The minimum is combined before the shuffle. The join key is a struct, by which
    nothing is partitioned yet: both inputs are plain shuffles and adaptive execution
    can split the rows of a vertex that has a third of all edges.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("_k"), "m")
    return pairs.withColumn("_k", F.struct("u")).join(least, "_k").drop("_k")


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (
        _with_least(both)
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )
    small = _with_least(large)
    return (
        small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u != v")
        .distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every vertex that has an edge to another; the
    component is its smallest vertex. Rounds go on until no edge changes; their number
    grows with the logarithm of the longest chain."""
    current = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges"
    )
    seen = None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        after = materialize(_stars(current), "edges")
        discard(current)
        current = after
    own = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
