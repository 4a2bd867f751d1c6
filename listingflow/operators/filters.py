"""Row filters and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.defaults import REJECTION_REASON
from listingflow.functions.rules import blacklist_hit
from listingflow.functions.text import text_or_empty
from listingflow.operators.containment import contained, numbered
from listingflow.scratch import materialize_observed


def flag_rejected(
    df: DataFrame,
    terms: Sequence[str],
    columns: Sequence[str] = ("company", "title"),
    reason: str = REJECTION_REASON,
) -> DataFrame:
    """Add ``rejection_reason``: null for a kept row."""
    return df.withColumn(
        "rejection_reason", F.when(blacklist_hit(columns, terms), F.lit(reason))
    )


def flag_by_table(
    df: DataFrame,
    terms: DataFrame,
    columns: Sequence[str] = ("company", "title"),
    reason: str = REJECTION_REASON,
    term: str = "term",
    ord_col: str = "ord",
) -> DataFrame:
    """``flag_rejected`` with the terms in a table of any size; blank terms match nothing.

    Each different text is searched once, through an index of the terms' rarest runs of
    characters (``containment``); rows then learn by their texts whether one of them holds a
    term.
    """
    wanted = terms.select(F.lower(F.trim(text_or_empty(term))).alias("term")).where("term != ''")
    parts = df.select(ord_col, F.explode(F.array_distinct(F.array(*[F.lower(text_or_empty(c)) for c in columns]))).alias("text"))
    texts = numbered(parts)
    bad = texts.join(contained(texts, wanted), "text_id", "left_semi").select(F.struct("text").alias("_k"))
    hits = parts.withColumn("_k", F.struct("text")).join(bad, "_k", "left_semi").select(ord_col, F.lit(True).alias("_hit")).distinct()
    return df.join(hits, ord_col, "left").withColumn("rejection_reason", F.when(F.col("_hit"), F.lit(reason))).drop("_hit")


def split_rejected(df: DataFrame, terms: Sequence[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) from one flagged frame; both are narrow filters."""
    flagged = flag_rejected(df, terms, **kw)
    kept = flagged.where(F.col("rejection_reason").isNull()).drop("rejection_reason")
    return kept, flagged.where(F.col("rejection_reason").isNotNull())


def written_split(flagged: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept, rejected, counts): both sides from one written table, counted as it is written."""
    hit = F.col("rejection_reason").isNotNull()
    table, counts = materialize_observed(flagged, "split", kept=F.count_if(~hit), rejected=F.count_if(hit))
    return table.where(~hit).drop("rejection_reason"), table.where(hit), counts


def reject_counts(flagged: DataFrame) -> DataFrame:
    """How many rows were kept and rejected."""
    return flagged.groupBy(F.col("rejection_reason").isNotNull().alias("rejected")).agg(
        F.count(F.lit(1)).alias("n")
    )


def at_least(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows with a numeric score at or above the threshold; other values never pass."""
    return df.where(F.col(score).try_cast("double") >= threshold)


def recent_only(df: DataFrame, as_of: Column, age_hours: int, posted: str = "posted") -> DataFrame:
    """Rows posted within the age, counted in whole days and at least one."""
    return df.where(F.col(posted) >= F.date_sub(as_of, max(1, age_hours // 24)))


def enabled_sources(df: DataFrame, switches: dict[str, bool], source: str = "source") -> DataFrame:
    """Drop sources that are switched off; a source without a switch is on. On a
    table partitioned by source this prunes partitions."""
    off = [s for s, on in switches.items() if not on]
    return df.where(~F.col(source).isin(*off)) if off else df


def with_title_or_id(df: DataFrame, title: str = "title", job_id: str = "job_id") -> DataFrame:
    """Drop cards that have neither a title nor an id."""
    return df.where((text_or_empty(title) != "") | (text_or_empty(job_id) != ""))


def with_html(df: DataFrame, html: str = "html") -> DataFrame:
    """Pages that were fetched: an empty page has no rows."""
    return df.where(text_or_empty(html) != "")


def positive_count(df: DataFrame, count: str = "jobs_found") -> DataFrame:
    return df.where(F.col(count) > 0)
