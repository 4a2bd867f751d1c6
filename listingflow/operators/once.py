"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind an unfolded one-element array.

    A filter on a plainly projected column is pushed below the projection by copying
    the column's expression, and a costly expression would run once per mention. The
    optimizer does not copy expressions out of a generator, filters on other columns
    still pass through it to the scan, and it stays inside generated code.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))
