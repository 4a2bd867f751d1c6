"""Merging batches into a store, and lookups against earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import exact_key, slug
from listingflow.operators.dedup import kept_ords
from listingflow.operators.keys import anti_join, first_per_key, join_key, latest_per_key, pick_rows


def drop_private(df: DataFrame) -> DataFrame:
    """Drop working columns, whose names begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def union_sources(frames: Sequence[DataFrame], ord_col: str = "ord", stride: int = 1 << 48) -> DataFrame:
    """Concatenate sources in the given order; ``ord`` keeps the order within each.

    An ``ord`` outside ``0 .. stride - 1`` would run into another source's range, so it
    fails the job.
    """
    out: DataFrame | None = None
    outside = F.raise_error(F.concat(F.lit("ord out of range: "), F.col(ord_col).cast("string"))).cast("long")
    fits = (F.col(ord_col) >= 0) & (F.col(ord_col) < stride)
    for i, frame in enumerate(frames):
        placed = frame.withColumn(ord_col, F.when(fits, F.col(ord_col) + F.lit(i * stride)).otherwise(outside))
        out = placed if out is None else out.unionByName(placed, allowMissingColumns=True)
    return out


def merge_new(
    store: DataFrame,
    batch: DataFrame,
    id_col: str = "job_id",
    content: Sequence[str] = ("title", "company", "location"),
    ord_col: str = "ord",
    small_batch: bool = False,
) -> DataFrame:
    """Rows of ``batch`` to append to ``store``.

    A row is old if its id or its content is in the store. The two keys are two
    equi anti-joins in a row, never one OR-join. Within the batch the first-seen
    rule applies with the same two keys; a blank id is not a key.
    """
    # The keys alone go through the joins and rounds; wide rows are picked once at the end.
    fresh = batch.select(ord_col, id_col, *content)
    fresh = anti_join(fresh, store, [id_col], ord_col, blank_never_matches=True, small_left=small_batch)
    fresh = anti_join(fresh, store, list(content), ord_col, small_left=small_batch)
    return pick_rows(drop_private(batch), first_of_batch(fresh, id_col, content, ord_col), ord_col)


def first_of_batch(rows: DataFrame, id_col: str, content: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """``ord`` of the rows that are the first of their id and of their content among
    ``rows``; a blank id is not a key."""
    keys = {
        "id_key": F.nullif(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("")),
        "content_key": exact_key(*content),
    }
    return kept_ords(rows, keys, ord_col)


def unscored(
    listings: DataFrame,
    cache: DataFrame,
    keys: Sequence[str] = ("title", "company"),
    dedup_in_batch: bool = False,
    ord_col: str = "ord",
    small_batch: bool = False,
) -> DataFrame:
    """Listings whose title and company have no score yet. With ``dedup_in_batch``
    only the first of equal (title, company) rows is returned."""
    fresh = anti_join(listings, cache, list(keys), ord_col, small_left=small_batch)
    return first_per_key(fresh, list(keys), ord_col) if dedup_in_batch else fresh


def lookup_latest(
    left: DataFrame,
    store: DataFrame,
    keys: Sequence[str] = ("title", "company"),
    ord_col: str = "ord",
) -> DataFrame:
    """Attach the last stored row of the same key; ``found`` says whether there is one.

    Store columns come back with the prefix ``store_``. A missing key part is an empty one.
    """
    last = latest_per_key(store, list(keys), ord_col)
    key = join_key([F.col(k) for k in keys]).alias("_key")
    renamed = last.select(
        key,
        *[F.col(c).alias(f"store_{c}") for c in store.columns if c not in keys],
        F.lit(True).alias("found"),
    )
    joined = left.select("*", key).join(renamed, "_key", "left").drop("_key")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def progress_key(company: str = "company", title: str = "title"):
    """Key of a row in the progress table."""
    return slug(F.concat_ws("_", F.coalesce(company, F.lit("")), F.coalesce(title, F.lit(""))))


def not_done(rows: DataFrame, progress: DataFrame, key: str = "job_key") -> DataFrame:
    """Rows that are absent from progress or not done there. A row is dropped only
    by a "done" entry, so this is an anti-join with the done keys."""
    return anti_join(rows, progress.where(F.col("status") == "done"), [key])


def not_in_progress(rows: DataFrame, progress: DataFrame, key: str = "job_key") -> DataFrame:
    """Rows without any progress entry, whatever its status."""
    return anti_join(rows, progress, [key])


def reuse_key(category: str = "category", title: str = "title"):
    """Key under which an earlier result may be used again."""
    return F.concat_ws("_", slug(category), slug(title))


def reuse_lookup(rows: DataFrame, results: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Folder of an earlier result with the same category and title, and within the
    batch the first row that will produce it."""
    keyed = rows.withColumn("reuse_key", reuse_key())
    # Struct keys: adaptive execution can split a key that most rows share.
    key = join_key([F.col("reuse_key")]).alias("_key")
    earlier = results.groupBy("reuse_key").agg(F.min("folder").alias("reuse_folder")).select(key, "reuse_folder")
    firsts = keyed.groupBy("reuse_key").agg(F.min(ord_col).alias("first_ord")).select(key, "first_ord")
    known = firsts.join(earlier, "_key", "left").select(F.struct(F.col("_key").alias("k")).alias("_key"), "reuse_folder", "first_ord")
    return (
        keyed.select("*", F.struct(key.alias("k")).alias("_key"))
        .join(known, "_key")
        .drop("_key")
        .withColumn(
            "reuse_of",
            F.when(
                F.col("reuse_folder").isNull() & (F.col("first_ord") != F.col(ord_col)),
                F.col("first_ord"),
            ),
        )
        .drop("first_ord")
    )
