"""Labels for listings from titles, keywords and landed responses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.rules import (
    best_label, first_pattern, keyword_points, label_in_response,
)
from listingflow.functions.text import text_or_empty
from listingflow.operators.once import once


def keyword_label(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]],
    preference: Sequence[str],
    default: str,
    title: str = "title",
    description: str = "description",
    category: str = "category",
    out: str = "label",
) -> DataFrame:
    """Add the label whose keywords score highest in title, category and description.

    Texts are lowered once and each distinct keyword is looked up once, however many
    labels share it.
    """
    low = F.lower(text_or_empty(title))
    text = F.concat_ws(" ", low, F.lower(text_or_empty(category)), F.lower(text_or_empty(description)))
    texts = once(df, {"_low": low, "_text": text})
    distinct = sorted({k for words in keywords.values() for k in words})
    name = {k: f"_k{i}" for i, k in enumerate(distinct)}
    points = once(texts, {name[k]: keyword_points(F.col("_low"), F.col("_text"), k) for k in distinct})
    totals = {}
    for label, words in keywords.items():
        total = F.lit(0)
        for k in words:
            total = total + F.col(name[k])
        totals[label] = total
    return points.select(*df.columns, best_label(totals, preference, default).alias(out))


def detect_label(
    df: DataFrame,
    patterns: Mapping[str, Sequence[str]],
    precedence: Sequence[str],
    keywords: Mapping[str, Sequence[str]],
    preference: Sequence[str],
    default: str,
    title: str = "title",
    out: str = "label",
    **columns: str,
) -> DataFrame:
    """Title patterns decide first; the keyword score where none matched."""
    scored = keyword_label(df, keywords, preference, default, title=title, out="_by_keyword", **columns)
    return scored.withColumn(
        out, F.coalesce(first_pattern(title, patterns, precedence), F.col("_by_keyword"))
    ).drop("_by_keyword")


def response_label(df: DataFrame, response: str, labels: Sequence[str], fallback: str, out: str = "label") -> DataFrame:
    """First valid label contained in a landed response; else the fallback column."""
    return df.withColumn(out, label_in_response(response, labels, F.col(fallback)))
