"""Ranking, top-k and prefix operators. Every order ends in ``ord``, so it is total."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.scratch import materialize


def by_score(df: DataFrame, score: str = "score", ord_col: str = "ord") -> DataFrame:
    """Best score first; equal scores stay in arrival order."""
    return df.orderBy(F.col(score).desc(), F.col(ord_col).asc())


def top_n(df: DataFrame, n: int, score: str = "score", ord_col: str = "ord") -> DataFrame:
    """The best ``n`` rows; each task keeps its own best ``n`` first."""
    return by_score(df, score, ord_col).limit(n)


def ranked_top(df: DataFrame, n: int, score: str = "score", ord_col: str = "ord") -> DataFrame:
    """The best ``n`` rows with their rank from 1. The window runs over ``n`` rows only."""
    w = Window.orderBy(F.col(score).desc(), F.col(ord_col).asc())
    return top_n(df, n, score, ord_col).withColumn("rank", F.row_number().over(w))


def top_per_group(
    df: DataFrame, groups: Sequence[str], n: int, score: str = "score", ord_col: str = "ord"
) -> DataFrame:
    """The best ``n`` rows of each group. Spark limits every group within each task
    before the shuffle, so a hot group sends at most ``n`` rows per task."""
    w = Window.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(ord_col).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_groups(df: DataFrame, key: str, k: int, ord_col: str = "ord", default: str = "Unknown") -> DataFrame:
    """The ``k`` most frequent values; ties go to the value that appeared first."""
    counted = df.groupBy(F.coalesce(F.col(key), F.lit(default)).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ord_col).alias("first_ord")
    )
    return counted.orderBy(F.col("n").desc(), F.col("first_ord").asc()).limit(k)


def prefix_until(
    df: DataFrame, n: int, threshold: float, score: str = "score", ord_col: str = "ord"
) -> DataFrame:
    """Rows in arrival order up to and including the ``n``-th hit.

    The cut is the largest of the ``n`` smallest ``ord`` among the hits; it is one
    number, read by a scalar subquery. With fewer hits the whole input is returned.
    """
    hits = (
        df.where(F.col(score) >= threshold)
        .select(F.col(ord_col).alias("_hit"))
        .orderBy("_hit")
        .limit(n)
    )
    cut = hits.agg(F.when(F.count(F.lit(1)) >= n, F.max("_hit")).alias("cut")).scalar()
    return df.where(F.col(ord_col) <= F.coalesce(cut, F.lit((1 << 63) - 1)))


def prefix_until_scored(
    df: DataFrame,
    scored: Callable[[DataFrame], DataFrame],
    n: int,
    threshold: float,
    score: str = "score",
    ord_col: str = "ord",
) -> DataFrame:
    """``prefix_until`` over ``scored(df)``, without scoring what lies far behind the cut.

    ``ord`` is walked in ranges, each as wide as all before it together; a range is scored
    and written, and the walk ends with the range of the ``n``-th hit. Where ``ord`` has no
    large gaps, at most about twice the rows of the answer are scored. ``scored`` keeps
    ``ord`` and decides about each row by itself.
    """
    span = df.agg(F.min(ord_col).alias("low"), F.max(ord_col).alias("high")).first()
    if span["low"] is None or n <= 0:
        return scored(df.limit(0))
    parts, hits, low, width = [], 0, span["low"], n
    while low <= span["high"] and hits < n:
        part = materialize(scored(df.where(F.col(ord_col).between(low, low + width - 1))), "prefix")
        hits += part.where(F.col(score) >= threshold).count()
        parts.append(part)
        low, width = low + width, low + width - span["low"]
    return prefix_until(reduce(DataFrame.unionByName, parts), n, threshold, score, ord_col)
