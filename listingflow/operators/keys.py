"""Key helpers shared by the join operators.

All of them expect ``ord``, a unique number per row that gives the arrival order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_key(parts: Sequence[Column], blank: Column | None = None, ord_col: Column | None = None) -> Column:
    """A struct key; a missing part is an empty one. Rows without a key get their own ``ord`` as a second part, so
    they match nothing and spread over all partitions instead of filling one."""
    values = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    own = F.lit(-1).cast("long")
    if blank is not None:
        own = F.when(blank, ord_col.cast("long")).otherwise(own)
    named = [v.alias(f"k{i}") for i, v in enumerate(values)]
    return F.struct(*named, own.alias("own"))


def anti_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ord_col: str = "ord",
    blank_never_matches: bool = False,
    small_left: bool = False,
) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right``.

    With ``small_left``, as for a micro-batch against its store, the right side is first cut
    down to keys that the left side has. Where Spark finds the left keys small enough to
    broadcast, the store is only scanned and never shuffled.

    The right side is reduced to distinct keys with map-side combine. The join key
    is a struct, which no earlier exchange is partitioned by: both inputs of the
    join are then plain shuffle stages, and adaptive execution can split a hot key
    of ``left`` over many tasks.
    """
    blank_left = blank_right = None
    if blank_never_matches:
        for k in keys:
            missing = F.coalesce(F.col(k).cast("string"), F.lit("")) == ""
            blank_left = missing if blank_left is None else blank_left & missing
        blank_right = blank_left
    known = right.select(*keys)
    if blank_right is not None:
        known = known.where(~blank_right)
    if small_left:
        wanted = left.select(join_key([F.col(k) for k in keys]).alias("_want")).distinct()
        known = known.join(wanted, join_key([F.col(k) for k in keys]) == F.col("_want"), "left_semi")
    known = known.distinct().select(join_key([F.col(k) for k in keys]).alias("_key"))
    probe = left.withColumn(
        "_key", join_key([F.col(k) for k in keys], blank_left, F.col(ord_col))
    )
    return probe.join(known, "_key", "left_anti").drop("_key")


def pick_rows(df: DataFrame, chosen: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Rows of ``df`` whose ``ord`` is in ``chosen``. ``ord`` is unique, so this
    join has no hot key whatever the data look like."""
    return df.join(chosen.select(ord_col), ord_col, "left_semi")


def _plain(keys: Sequence[str]) -> list[Column]:
    """Key columns in which a missing part is an empty one, as in ``join_key``."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]


def first_per_key(df: DataFrame, keys: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The earliest row of every key: minimum with map-side combine, then a join on ``ord``."""
    firsts = df.groupBy(*_plain(keys)).agg(F.min(ord_col).alias(ord_col))
    return pick_rows(df, firsts, ord_col)


def latest_per_key(df: DataFrame, keys: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The last written row of every key."""
    lasts = df.groupBy(*_plain(keys)).agg(F.max(ord_col).alias(ord_col))
    return pick_rows(df, lasts, ord_col)
