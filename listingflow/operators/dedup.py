"""First-seen deduplication over several alternative keys.

A row is kept if no earlier *kept* row shares one of its keys; a rejected row
registers nothing. Chained ``dropDuplicates`` calls give another answer.

The sequential rule is the greedy matching of a graph whose edges are rows and
whose nodes are key values. Each round keeps the rows that are first in every one
of their key groups, then drops the rows that share a key with a kept one. Most
inputs are settled in a few rounds. Rounds work on key digests only, never on the
wide rows.

Long alternating chains, in which each row shares one key with the row before and
another with the row after, would cost a round per two links. A row with exactly one
earlier undecided neighbour is kept if and only if that neighbour is not, so chains
of such rows are followed by pointer doubling, in as many joins as the logarithm of
the longest chain.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.functions.text import content_fingerprint, short_digest, url_fingerprint
from listingflow.operators.keys import pick_rows
from listingflow.scratch import discard, materialize


def listing_keys(
    company: str = "company", title: str = "title", location: str = "location", url: str = "url"
) -> dict[str, Column]:
    """The two keys of a listing: its content, and its URL where it has one."""
    return {
        "content_key": content_fingerprint(company, title, location),
        "url_key": F.nullif(url_fingerprint(url), F.lit("")),
    }


def _firsts(undecided: DataFrame, names: list[str], ord_col: str) -> DataFrame:
    """Rows that are first in all their key groups."""
    winners: DataFrame | None = None
    for n in names:
        first = undecided.groupBy(n).agg(F.min(ord_col).alias(ord_col))
        winners = first if winners is None else winners.join(first, ord_col)
    return winners.select(ord_col, *names)


def _pointers(undecided: DataFrame, names: list[str], ord_col: str) -> DataFrame:
    """``(ord, p)`` of every row with exactly one earlier neighbour ``p``: it is second in
    one key group and first in the others. Minima are combined before each shuffle."""
    ranked = undecided
    for i, n in enumerate(names):
        # The key is a struct, by which nothing is partitioned yet, so a hot one can be split.
        first = undecided.groupBy(n).agg(F.min(ord_col).alias("_first")).select(F.struct(n).alias("_k"), "_first")
        later = undecided.withColumn("_k", F.struct(n)).join(first, "_k").where(F.col(ord_col) > F.col("_first"))
        second = later.groupBy(n).agg(F.min("_first").alias(f"_p{i}"), F.min(ord_col).alias(ord_col))
        # A row is first (absent here), second (with its neighbour) or later (no neighbour known).
        late = later.select(ord_col, F.lit(1).alias(f"_l{i}")).join(
            second.select(ord_col, f"_p{i}"), ord_col, "left"
        )
        ranked = ranked.join(late, ord_col, "left")
    behind = sum((F.coalesce(F.col(f"_l{i}"), F.lit(0)) for i in range(len(names))), F.lit(0))
    only = F.coalesce(*[F.col(f"_p{i}") for i in range(len(names))])
    return ranked.where(behind == 1).select(ord_col, only.alias("p")).where("p is not null")


def _chained(undecided: DataFrame, winners: DataFrame, names: list[str], ord_col: str) -> DataFrame:
    """Rows kept because the chain before them ends, an even number of rows away, at a
    row that is first in all its groups."""
    jumps = materialize(
        _pointers(undecided, names, ord_col).select(ord_col, "p", F.lit(1).alias("steps"), F.lit(False).alias("end")),
        "dedup-jumps",
    )
    while True:
        target = jumps.select(F.col(ord_col).alias("p"), F.col("p").alias("_p"), F.col("steps").alias("_s"), F.col("end").alias("_e"))
        open_jumps = jumps.where(~F.col("end")).join(target, "p", "left")
        moved = materialize(
            jumps.where("end").unionByName(
                open_jumps.select(
                    ord_col,
                    F.coalesce("_p", "p").alias("p"),
                    ((F.col("steps") + F.coalesce("_s", F.lit(0))) % 2).cast("int").alias("steps"),
                    (F.col("_p").isNull() | F.coalesce("_e", F.lit(False))).alias("end"),
                )
            ),
            "dedup-jumps",
        )
        discard(jumps)
        jumps = moved
        if jumps.where(~F.col("end")).isEmpty():
            break
    kept = jumps.where("steps = 0").join(winners.select(F.col(ord_col).alias("p")), "p", "left_semi").select(ord_col)
    return pick_rows(undecided, kept, ord_col).select(ord_col, *names)


#: Rounds before chains are followed: most inputs need no more.
PLAIN_ROUNDS = 2


def kept_ords(df: DataFrame, keys: Mapping[str, Column], ord_col: str = "ord") -> DataFrame:
    """``ord`` of every row the first-seen rule keeps.

    A null key is exempt. Rows equal in all keys are reduced to their first before
    anything else, with map-side combine, so a group of copies costs one row. Rounds go
    on until nothing is undecided; the plan is the same at every size and no row is ever
    left out.
    """
    return _kept_and_read(df, keys, ord_col)[0]


def _kept_and_read(df: DataFrame, keys: Mapping[str, Column], ord_col: str) -> tuple[DataFrame, DataFrame]:
    """``kept_ords``, and the written reduction of the rows, with ``n`` of them in each group.
    ``df`` is read once, for the reduction."""
    names = list(keys)
    # The rounds move every key some ten times, so they have 16 bytes of each.
    keyed = df.select(
        F.col(ord_col).cast("long").alias(ord_col),
        *[short_digest(F.concat(F.lit("v:"), c.cast("string"))).alias(n) for n, c in keys.items()],
    )
    # A row without a key is alone in a group of its own for that key. The prefixes keep
    # its stand-in apart from every real value.
    own = short_digest(F.concat(F.lit("o:"), F.col(ord_col).cast("string")))
    # Rows without any key are all kept and must not be reduced to one.
    all_null = F.lit(True)
    for n in names:
        all_null = all_null & F.col(n).isNull()
    free = F.when(all_null, F.struct(ord_col)).alias("_free")
    pairs = keyed.groupBy(*names, free).agg(F.min(ord_col).alias(ord_col), F.count(F.lit(1)).alias("n"))
    start = materialize(
        pairs.select(
            ord_col, *[F.coalesce(n, own).alias(n) for n in names], "_free", "n"
        ),
        "dedup-start",
    )
    undecided = start.where("_free is null").select(ord_col, *names)
    # A row without a key stands for every row with its ``ord``.
    kept = start.where("_free is not null").select(F.explode(F.array_repeat(ord_col, F.col("n").cast("int"))).alias(ord_col))
    rounds = 0
    while True:
        winners = materialize(_firsts(undecided, names, ord_col), "dedup-winners")
        if rounds >= PLAIN_ROUNDS:
            chained = _chained(undecided, winners, names, ord_col)
            winners = materialize(winners.unionByName(chained), "dedup-winners")
        kept = kept.union(winners.select(ord_col))
        rest = undecided
        for n in names:
            rest = rest.join(winners.select(n), n, "left_anti")
        after = materialize(rest.select(ord_col, *names), "dedup-rest")
        discard(undecided)
        undecided = after
        rounds += 1
        if undecided.isEmpty():
            return kept, start


def first_seen(df: DataFrame, keys: Mapping[str, Column] | None = None, ord_col: str = "ord") -> DataFrame:
    """Rows kept by the first-seen rule, with all their columns."""
    return pick_rows(df, kept_ords(df, keys or listing_keys(), ord_col), ord_col)


def first_seen_counts(df: DataFrame, keys: Mapping[str, Column] | None = None, ord_col: str = "ord") -> DataFrame:
    """One row: how many rows came in, were kept, and were duplicates."""
    kept, read = _kept_and_read(df, keys or listing_keys(), ord_col)
    flags = read.select(F.col("n").alias("total"), F.lit(0).alias("kept")).unionAll(
        kept.select(F.lit(0).alias("total"), F.lit(1).alias("kept"))
    )
    return flags.agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("kept"), F.lit(0)).cast("long").alias("kept"),
    ).select("total", "kept", (F.col("total") - F.col("kept")).alias("duplicates"))
