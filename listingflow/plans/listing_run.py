"""A whole run: landed pages to listings, listings to scores, results to reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.defaults import MAX_PAGES, MIN_SCORE, TARGET_LISTINGS
from listingflow.functions.score import ScoreRules
from listingflow.operators import search
from listingflow.operators.dedup import kept_ords, listing_keys
from listingflow.operators.filters import at_least, split_rejected, with_title_or_id
from listingflow.operators.keys import pick_rows
from listingflow.operators.merge import merge_new, not_done, progress_key, unscored
from listingflow.operators.scoring import score_entries, score_listings
from listingflow.operators.stats import daily_trend, fetch_stats, run_totals
from listingflow.operators.topk import prefix_until, ranked_top
from listingflow.scratch import materialize
from listingflow.sources import stores
from listingflow.sources.html import normalize_cards

#: Rows of a page that ``ord`` has room for.
ROWS_PER_PAGE = 1 << 20


def listings_from_pages(
    pages: DataFrame,
    parse: Callable[[DataFrame, Sequence[str]], DataFrame],
    source: str,
    as_of: Column,
    aliases: Mapping[str, Sequence[str]],
    defaults: Mapping[str, str],
    max_pages: int = MAX_PAGES,
) -> tuple[DataFrame, DataFrame]:
    """Listings of one source and its fetch log.

    ``pages(task_ord, keyword, category, location, mode, page, html, failed, duration)`` has
    a row for each landed page of a search; ``parse`` gives its raw cards with their ``pos``.
    A search is read up to its first page without rows and up to the page on which too many
    ids came before; a repeated id within a search is dropped; the search's mode sets the
    place. ``ord`` follows searches, pages and positions.
    """
    landed = search.page_limit(pages, max_pages).withColumnRenamed("location", "location_hint")
    keep = ["task_ord", "keyword", "category", "location_hint", "mode", "page"]
    place = (F.col("task_ord") * max_pages + F.col("page")) * ROWS_PER_PAGE + F.col("pos")
    raw = with_title_or_id(parse(landed, keep)).withColumn("ord", place.cast("long")).withColumnRenamed("task_ord", "task")
    counted = raw.groupBy("task", "page").agg(F.count(F.lit(1)).alias("rows"))
    fetched = landed.select(F.col("task_ord").alias("task"), "page", "failed", "duration").join(counted, ["task", "page"], "left")
    read = materialize(search.before_empty_page(fetched, "rows", "task", "page").select("task", "page"), "pages-read")
    rows = raw.join(read, ["task", "page"], "left_semi")
    firsts = search.first_ids(rows)
    stats = search.page_stats(rows, firsts)
    cut = search.cut_pages(stats)
    new = search.until_duplicates(rows)
    listed = normalize_cards(new, source, as_of, aliases, defaults)
    placed = listed.join(new.select("ord", "mode", F.col("location_hint").alias("_hint")), "ord")
    moded = placed.withColumn("location", search.mode_location("location", "mode", "_hint")).drop("mode", "_hint")
    log = (
        fetched.join(stats.select("task", "page", "dups"), ["task", "page"], "left")
        .join(cut, "task", "left")
        .where(F.col("cut_page").isNull() | (F.col("page") <= F.col("cut_page")))
        .select(
            F.lit(source).alias("source"), "task", "page", F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("dups", F.lit(0)).alias("dups"), "failed",
            F.coalesce(F.col("page") == F.col("cut_page"), F.lit(False)).alias("early_stopped"), "duration",
        )
    )
    return moded, log


@dataclass(frozen=True)
class RunResult:
    kept: DataFrame
    rejected: DataFrame
    new: DataFrame
    scored: DataFrame
    recommended: DataFrame


def run(
    listings: DataFrame,
    store: DataFrame | None,
    profile: DataFrame,
    rules: ScoreRules,
    as_of: Column,
    blacklist: Sequence[str] = (),
    min_score: float = MIN_SCORE,
    target: int = TARGET_LISTINGS,
    posted: str = "posted",
    cache: DataFrame | None = None,
    progress: DataFrame | None = None,
    stop_at_target: bool = False,
) -> RunResult:
    """Deduplicate, reject, merge, score and recommend.

    ``cache`` holds earlier scores: what it has is not scored again. With
    ``stop_at_target`` scoring ends, in arrival order, with the row that makes the target.
    Rows that ``progress`` has as done are not recommended. Written in between are ``ord``
    of the kept rows and, once, the scored rows.
    """
    unique = pick_rows(listings, materialize(kept_ords(listings, listing_keys()), "unique"))
    kept, rejected = split_rejected(unique, blacklist)
    new = kept if store is None else merge_new(store, kept)
    fresh = new if cache is None else unscored(new, cache)
    scored = materialize(score_listings(fresh, profile, rules, as_of, posted=posted), "scored")
    if stop_at_target:
        scored = prefix_until(scored, target, min_score)
    best = at_least(scored, min_score)
    if progress is not None:
        open_rows = not_done(scored.select("ord", progress_key().alias("job_key")), progress)
        best = pick_rows(best, open_rows)
    recommended = ranked_top(best, target)
    return RunResult(kept, rejected, new, scored, recommended)


def write_run(result: RunResult, path: str, log: DataFrame, progress: DataFrame, as_of: Column, runtime_seconds: Column) -> None:
    """The run's files below ``path``: reports, score cache rows, progress, trend and one
    row of run statistics."""
    stores.write_report(stores.scraped_report(result.kept), f"{path}/scraped")
    stores.write_report(stores.filtered_report(result.rejected), f"{path}/filtered")
    stores.write_report(stores.recommended_report(result.recommended), f"{path}/recommended")
    stores.append_rows(score_entries(result.scored), f"{path}/cache")
    done = result.recommended.select(progress_key().alias("job_key"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("folder"), "ord")
    after = stores.update_progress(progress, done)
    stores.write_progress(after, f"{path}/progress")
    stores.write_report(daily_trend(result.kept, as_of), f"{path}/trend")
    totals = run_totals(result.kept, result.scored, result.recommended, after, as_of)
    stores.append_rows(stores.run_stats_row(totals, fetch_stats(log), runtime_seconds), f"{path}/statistics")
