"""Search tasks, their URLs, and the paging rules over landed result pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.defaults import DUPLICATE_STOP_SHARE, MAX_PAGES
from listingflow.functions.text import col, form_encode, percent_encode, text_or_empty
from listingflow.operators.keys import join_key, pick_rows


def location_variants(cities: Sequence[str], modes: dict[str, bool] | None = None) -> list[tuple[str, str]]:
    """(location, mode) pairs of every keyword; a mode that is not named is on."""
    on = lambda m: (modes or {}).get(m, True)
    out = [(c, "onsite") for c in cities]
    if on("remote"):
        out.append(("Remote", "remote"))
    if on("hybrid"):
        out += [(f"{c} (Hybrid)", "hybrid") for c in cities[:2]]
    if on("work_from_home"):
        out.append(("Work From Home", "wfh"))
    if on("india_wide"):
        out.append(("All India", "india"))
    return out


def task_grid(keywords: DataFrame, variants: Sequence[tuple[str, str]], ord_col: str = "keyword_ord") -> DataFrame:
    """Every keyword with every variant. The variants are a constant list inside the
    row, so the grid is one narrow step and not a join."""
    choices = F.array(
        *[F.struct(F.lit(place).alias("location"), F.lit(mode).alias("mode")) for place, mode in variants]
    )
    grid = keywords.select("*", F.posexplode(choices).alias("variant", "v"))
    return grid.select(
        *keywords.columns, "variant", F.col("v")["location"].alias("location"), F.col("v")["mode"].alias("mode"),
        (F.col(ord_col) * len(variants) + F.col("variant")).alias("task_ord"),
    )


# The shapes of the three search addresses below.
def path_search_url(base: str, keyword, location, page) -> Column:
    """Words in the path, pages counted from 1 and named from the second on."""
    low = lambda c: percent_encode(F.trim(F.lower(col(c))))
    url = F.concat(F.lit(base), low(keyword), F.lit("-jobs-in-"), low(location))
    p = col(page)
    return F.when(p > 0, F.concat(url, F.lit("?pageNo="), (p + 1).cast("string"))).otherwise(url)


def query_search_url(base: str, keyword, location, page, age_hours: int) -> Column:
    """Words in the query, ten rows per page, age in days."""
    plus = lambda c: F.replace(text_or_empty(c), F.lit(" "), F.lit("+"))
    return F.concat(
        F.lit(base), F.lit("/jobs?q="), plus(keyword), F.lit("&l="), plus(location),
        F.lit("&start="), (col(page) * 10).cast("string"),
        F.lit(f"&sort=date&fromage={max(1, age_hours // 24)}"),
    )


def guest_search_url(base: str, keyword, location, page) -> Column:
    """Encoded query with a fixed filter for the last 24 hours."""
    return F.concat(
        F.lit(base), F.lit("/jobs-guest/jobs/api/seeMoreJobPostings/search?keywords="),
        form_encode(keyword), F.lit("&location="), form_encode(location),
        F.lit("&start="), (col(page) * 10).cast("string"), F.lit("&f_TPR=r86400"),
    )


def mode_location(location, mode, task_location) -> Column:
    """Location after the search mode had its say."""
    m = col(mode)
    place = F.trim(F.split(text_or_empty(task_location), "\\(")[0])
    hybrid = F.when(
        F.contains(F.lower(text_or_empty(location)), F.lit("hybrid")), col(location)
    ).otherwise(F.concat(place, F.lit(" (Hybrid)")))
    return (
        F.when(m == "remote", F.lit("Remote"))
        .when(m == "hybrid", hybrid)
        .when(m == "wfh", F.lit("Work From Home"))
        .otherwise(col(location))
    )


def page_limit(df: DataFrame, max_pages: int = MAX_PAGES, page: str = "page") -> DataFrame:
    return df.where(F.col(page) < max_pages)


def before_empty_page(pages: DataFrame, rows: str = "rows", task: str = "task", page: str = "page") -> DataFrame:
    """Pages in front of the task's first page without rows (empty or failed)."""
    stop = (
        pages.where(F.coalesce(F.col(rows), F.lit(0)) == 0)
        .groupBy(task)
        .agg(F.min(page).alias("stop_page"))
    )
    return (
        _by_task(pages, stop, task, "stop_page")
        .where(F.col("stop_page").isNull() | (F.col(page) < F.col("stop_page")))
        .drop("stop_page")
    )


def _by_task(rows: DataFrame, limits: DataFrame, task: str, limit: str) -> DataFrame:
    """Attach a task's limit. The struct key lets adaptive execution split a hot task."""
    key = join_key([F.col(task)]).alias("_key")
    return rows.select("*", key).join(limits.select(key, limit), "_key", "left").drop("_key")


def first_ids(rows: DataFrame, task: str = "task", job_id: str = "job_id", page: str = "page", ord_col: str = "ord") -> DataFrame:
    """(task, page, ord) of the first row of each id within its task; rows without an
    id are all first. The minimum is combined map-side, so a repeated id is cheap."""
    named = rows.where(text_or_empty(job_id) != "")
    firsts = named.groupBy(task, job_id).agg(F.min(F.struct(page, ord_col)).alias("f"))
    return firsts.select(task, F.col("f")[page].alias(page), F.col("f")[ord_col].alias(ord_col)).unionByName(
        rows.where(text_or_empty(job_id) == "").select(task, page, ord_col)
    )


def first_in_task(rows: DataFrame, **names) -> DataFrame:
    """Rows whose id was not seen on an earlier row of the same task."""
    return pick_rows(rows, first_ids(rows, **names), names.get("ord_col", "ord"))


def page_stats(rows: DataFrame, firsts: DataFrame, task: str = "task", page: str = "page") -> DataFrame:
    """Rows and duplicates of each page."""
    counted = rows.select(task, page, F.lit(1).alias("r"), F.lit(0).alias("f")).unionAll(
        firsts.select(task, page, F.lit(0).alias("r"), F.lit(1).alias("f"))
    )
    return counted.groupBy(task, page).agg(
        F.sum("r").alias("rows"), (F.sum("r") - F.sum("f")).alias("dups")
    )


def cut_pages(stats: DataFrame, share: float = DUPLICATE_STOP_SHARE, task: str = "task", page: str = "page") -> DataFrame:
    """Last page read per task: the first page after page 0 with too many duplicates."""
    full = (F.col(page) > 0) & (F.col("dups") > 0) & (F.col("dups") / F.col("rows") >= share)
    return stats.where(full).groupBy(task).agg(F.min(page).alias("cut_page"))


def until_duplicates(rows: DataFrame, share: float = DUPLICATE_STOP_SHARE, task: str = "task", page: str = "page", ord_col: str = "ord", job_id: str = "job_id") -> DataFrame:
    """New rows of each task up to its duplicate cut; the cut page's new rows stay."""
    firsts = first_ids(rows, task, job_id, page, ord_col)
    cut = cut_pages(page_stats(rows, firsts, task, page), share, task, page)
    kept = _by_task(firsts, cut, task, "cut_page").where(
        F.col("cut_page").isNull() | (F.col(page) <= F.col("cut_page"))
    )
    return pick_rows(rows, kept, ord_col)
