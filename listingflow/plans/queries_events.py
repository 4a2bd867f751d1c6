"""Queries over run histories, fetch logs and search pages derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingflow.operators import health, search, stats
from listingflow.plans.driver_tables import AS_OF, LISTINGS_SQL, RUNS_SQL, SEARCH_SQL, as_of, listings, runs, search_rows, spread, table
from listingflow.plans.registry import query
from listingflow.sources import html as H
from listingflow.sources import stores

_STREAKS = f"""WITH {RUNS_SQL},
isl AS (SELECT *, sum(CASE WHEN jobs_found > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY run_ts) AS g FROM runs),
st AS (SELECT source, run_ts, jobs_found, CAST(sum(CASE WHEN jobs_found = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source, g ORDER BY run_ts) AS BIGINT) AS consecutive_zero FROM isl)"""


@query("health_streak", f"{_STREAKS} SELECT source, run_ts, jobs_found, consecutive_zero, consecutive_zero < 3 AS healthy FROM st")
def health_streak(spark, d):
    return health.zero_streaks(runs(spark, d))


@query("health_latest", f"""{_STREAKS} SELECT source, max(run_ts) AS last_run, arg_max(jobs_found, run_ts) AS jobs_found,
  arg_max(consecutive_zero, run_ts) AS consecutive_zero, arg_max(consecutive_zero, run_ts) < 3 AS healthy FROM st GROUP BY 1""")
def health_latest(spark, d):
    return health.current_health(health.zero_streaks(runs(spark, d)))


def _k():
    return F.from_json("props", "k bigint")["k"]


_K = "json_extract_string(props, '$.k')::BIGINT"
_LOG = f"""log AS (SELECT event_type AS source, user_id AS task, {_K} % 10 AS rows, least({_K} % 3, {_K} % 10) AS dups,
  {_K} % 7 = 0 AS failed, {_K} % 11 = 0 AS early_stopped, value AS duration FROM events)"""


def _fetch_log(spark, d):
    """One fetched page per event."""
    e = table(spark, d, "events").withColumn("_k", _k())
    k = F.col("_k")
    return e.select(
        F.col("event_type").alias("source"), F.col("user_id").alias("task"), (k % 10).alias("rows"),
        F.least(k % 3, k % 10).alias("dups"), (k % 7 == 0).alias("failed"),
        (k % 11 == 0).alias("early_stopped"), F.col("value").alias("duration"),
    )


_STATS_COLS = """count(DISTINCT task) AS queries, count(*) FILTER (WHERE NOT failed AND rows > 0) AS pages_scraped,
  CAST(coalesce(sum(rows - dups) FILTER (WHERE NOT failed), 0) AS BIGINT) AS jobs_found,
  CAST(coalesce(sum(dups) FILTER (WHERE NOT failed), 0) AS BIGINT) AS duplicates, count(*) FILTER (WHERE failed) AS failed_requests, count(*) FILTER (WHERE early_stopped) AS early_stopped,
  floor(sum(duration::DECIMAL(28,6))::DOUBLE * 100 + 0.5::DOUBLE) / 100 AS total_duration,
  floor(sum(duration::DECIMAL(28,6))::DOUBLE / count(DISTINCT task) * 100 + 0.5::DOUBLE) / 100 AS avg_duration"""


@query("fetch_stats", f"WITH {_LOG} SELECT source, {_STATS_COLS} FROM log GROUP BY 1")
def fetch_stats(spark, d):
    return stats.fetch_stats(_fetch_log(spark, d))


@query("run_stats", f"""WITH {_LOG}, s AS (SELECT source, {_STATS_COLS} FROM log GROUP BY 1)
SELECT '{AS_OF}' AS date, 12.5::DOUBLE AS runtime_seconds, (SELECT count(*) FROM orders) AS total_scraped, s.* FROM s""")
def run_stats(spark, d):
    """The nested statistics row of a run, its map unfolded again for the comparison."""
    totals = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("total_scraped")).select(
        as_of().alias("date"), "total_scraped", F.lit(0).alias("total_scored"), F.lit(0).alias("recommended")
    )
    row = stores.run_stats_row(totals, stats.fetch_stats(_fetch_log(spark, d)), F.lit(12.5))
    return row.select("date", "runtime_seconds", "total_scraped", F.explode("sources").alias("source", "s")).select(
        "date", "runtime_seconds", "total_scraped", "source", "s.*"
    )


@query("phase_share", """WITH p AS (SELECT event_type AS phase, sum(value::DECIMAL(28,6))::DOUBLE AS s FROM events GROUP BY 1),
t AS (SELECT sum(value::DECIMAL(28,6))::DOUBLE AS t FROM events)
SELECT phase, floor(s * 100 + 0.5::DOUBLE) / 100 AS seconds, floor(s / t * 100 * 100 + 0.5::DOUBLE) / 100 AS percent FROM p, t""")
def phase_share(spark, d):
    e = table(spark, d, "events")
    return stats.phase_share(e.select(F.col("event_type").alias("phase"), F.col("value").alias("seconds")))


@query("counters", f"SELECT event_type AS key, CAST(sum({_K}) AS BIGINT) AS total FROM events GROUP BY 1")
def counters(spark, d):
    return stats.counters(table(spark, d, "events").select(F.col("event_type").alias("key"), _k().alias("n")))


@query("value_averages", """SELECT event_type AS key, floor(sum(value::DECIMAL(28,6))::DOUBLE / count(value) * 100 + 0.5::DOUBLE) / 100 AS average,
  count(value) AS n FROM events GROUP BY 1""")
def value_averages(spark, d):
    return stats.value_averages(table(spark, d, "events").select(F.col("event_type").alias("key"), "value"))


# ---- paging ----------------------------------------------------------------

_FIRST = """f AS (SELECT *, job_id = '' OR row_number() OVER (PARTITION BY task, job_id ORDER BY page, ord) = 1 AS is_first FROM search_rows)"""


@query("first_in_task", f"WITH {SEARCH_SQL}, {_FIRST} SELECT task, page, ord, job_id FROM f WHERE is_first")
def first_in_task(spark, d):
    return search.first_in_task(search_rows(spark, d)).select("task", "page", "ord", "job_id")


@query("page_cutoff", f"""WITH {SEARCH_SQL}, {_FIRST},
p AS (SELECT task, page, count(*) AS n, count(*) FILTER (WHERE NOT is_first) AS dups FROM f GROUP BY 1, 2),
c AS (SELECT task, min(page) AS cut FROM p WHERE page > 0 AND dups > 0 AND dups::DOUBLE / n >= 0.5 GROUP BY 1)
SELECT f.task, f.page, f.ord, f.job_id FROM f LEFT JOIN c USING (task) WHERE is_first AND page <= coalesce(cut, page)""")
def page_cutoff(spark, d):
    return search.until_duplicates(search_rows(spark, d)).select("task", "page", "ord", "job_id")


@query("stop_at_empty_page", f"""WITH {SEARCH_SQL}, p AS (SELECT task, page, count(*) FILTER (WHERE source = 'view') AS rows FROM search_rows GROUP BY 1, 2),
s AS (SELECT task, min(page) AS stop FROM p WHERE rows = 0 GROUP BY 1)
SELECT task, page, rows FROM p LEFT JOIN s USING (task) WHERE page < coalesce(stop, page + 1) AND page < 5""")
def stop_at_empty_page(spark, d):
    pages = search_rows(spark, d).groupBy("task", "page").agg(F.count_if(F.col("source") == "view").alias("rows"))
    return search.page_limit(search.before_empty_page(pages), 5)


# ---- tasks -----------------------------------------------------------------

CITIES = ["Port Nord", "Südhafen", "Ost/West", "Mitte"]
VARIANTS = search.location_variants(CITIES, {"india_wide": False})


def _tasks(spark, d):
    """A search keyword per customer segment and part type, with every variant."""
    types = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("keyword_ord"))
    keywords = types.select(F.concat_ws(" ", "p_name", "p_type").alias("keyword"), "keyword_ord")
    return search.task_grid(keywords, VARIANTS)


_VALUES = ", ".join(f"({i}, '{p}', '{m}')" for i, (p, m) in enumerate(VARIANTS))
_TASKS = f"""tasks AS (SELECT keyword, keyword_ord, variant, location, mode, keyword_ord * {len(VARIANTS)} + variant AS task_ord
  FROM (SELECT p_name || ' ' || p_type AS keyword, min(p_partkey) AS keyword_ord FROM part GROUP BY p_name, p_type),
  (VALUES {_VALUES}) v(variant, location, mode))"""


@query("task_grid", f"WITH {_TASKS} SELECT keyword, variant, location, mode, task_ord FROM tasks")
def task_grid(spark, d):
    return _tasks(spark, d).select("keyword", "variant", "location", "mode", "task_ord")


_Q = lambda x: f"replace(url_encode({x}), '%2F', '/')"
_F = lambda x: f"replace(url_encode({x}), '%20', '+')"


@query("search_urls", f"""WITH {_TASKS} SELECT task_ord, page,
  'https://a.example/' || {_Q('lower(keyword)')} || '-jobs-in-' || {_Q('lower(location)')} || CASE WHEN page > 0 THEN '?pageNo=' || (page + 1) ELSE '' END AS path_url,
  'https://b.example/jobs?q=' || replace(keyword, ' ', '+') || '&l=' || replace(location, ' ', '+') || '&start=' || page * 10 || '&sort=date&fromage=2' AS query_url,
  'https://c.example/jobs-guest/jobs/api/seeMoreJobPostings/search?keywords=' || {_F('keyword')} || '&location=' || {_F('location')} || '&start=' || page * 10 || '&f_TPR=r86400' AS guest_url
FROM tasks, (VALUES (0), (1), (2)) p(page)""")
def search_urls(spark, d):
    pages = _tasks(spark, d).select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("page"))
    return pages.select(
        "task_ord", "page",
        search.path_search_url("https://a.example/", "keyword", "location", "page").alias("path_url"),
        search.query_search_url("https://b.example", "keyword", "location", "page", 48).alias("query_url"),
        search.guest_search_url("https://c.example", "keyword", "location", "page").alias("guest_url"),
    )


_MODE = "CASE category WHEN 'small' THEN 'remote' WHEN 'promo' THEN 'hybrid' WHEN 'large' THEN 'wfh' ELSE 'onsite' END"


@query("mode_locations", f"""WITH {LISTINGS_SQL} SELECT ord, {_MODE} AS mode, CASE {_MODE} WHEN 'remote' THEN 'Remote' WHEN 'wfh' THEN 'Work From Home'
  WHEN 'hybrid' THEN CASE WHEN contains(lower(location), 'hybrid') THEN location ELSE source || ' (Hybrid)' END ELSE location END AS location FROM listings""")
def mode_locations(spark, d):
    mode = F.when(F.col("category") == "small", "remote").when(F.col("category") == "promo", "hybrid").when(F.col("category") == "large", "wfh").otherwise("onsite")
    rows = listings(spark, d, description=False).withColumn("mode", mode)
    task_place = F.concat("source", F.lit(" (Hybrid)"))
    return rows.select("ord", "mode", search.mode_location("location", "mode", task_place).alias("location"))


# ---- landed JSON -----------------------------------------------------------


@query("embedded_json", f"""SELECT event_id, 'page-' || event_id AS title, CAST({_K} AS VARCHAR) AS job_id,
  CASE WHEN {_K} = 0 THEN '' ELSE event_type END AS company FROM events""")
def embedded_json(spark, d):
    """Rows of a JSON object after a script marker, with trailing page text."""
    e = spread(spark, d, "events").withColumn("_k", _k())
    row = F.to_json(
        F.struct(
            F.col("_k").cast("string").alias("jk"), F.concat(F.lit("page-"), F.col("event_id").cast("string")).alias("title"),
            F.when(F.col("_k") != 0, F.col("event_type")).otherwise(F.lit("")).alias("company"),
        )
    )
    page = F.concat(
        F.lit("<html><script>var a={};window._initialData= {\"note\":\"}{\",\"jobs\":["), row, F.lit("]};</script></html>")
    )
    pages = e.select("event_id", page.alias("html"), F.lit("k").alias("keyword"), F.lit("here").alias("location_hint"))
    found = H.marker_json_listings(pages, ["event_id"], "https://b.example")
    return found.select("event_id", "title", F.col("job_key").alias("job_id"), "company")


@query("progress_map", f"""SELECT event_type || '_' || event_id AS job_key, CASE WHEN {_K} % 2 = 0 THEN 'done' ELSE 'failed' END AS status,
  'out/' || {_K} AS folder FROM events WHERE {_K} % 13 <> 0""")
def progress_map(spark, d):
    """Progress maps as landed text; broken ones give no rows."""
    e = table(spark, d, "events").withColumn("_k", _k())
    entry = F.create_map(
        F.concat_ws("_", "event_type", F.col("event_id").cast("string")),
        F.struct(
            F.when(F.col("_k") % 2 == 0, "done").otherwise("failed").alias("status"),
            F.concat(F.lit("out/"), F.col("_k").cast("string")).alias("folder"),
        ),
    )
    landed = e.select(F.when(F.col("_k") % 13 == 0, F.lit("{broken")).otherwise(F.to_json(entry)).alias("value"))
    return stores.parse_keyed_map(landed, "value", stores.PROGRESS_TYPE, "job_key")


@query("progress_done", f"SELECT count(*) AS done FROM events WHERE {_K} % 13 <> 0 AND {_K} % 2 = 0")
def progress_done(spark, d):
    return progress_map(spark, d).agg(F.count_if(F.col("status") == "done").alias("done"))


@query("health_map", f"""SELECT event_type || event_id AS source, '2024-01-01' AS last_run, {_K} AS jobs_found, 1.0::DOUBLE AS http_success_rate,
  {_K} % 5 AS consecutive_zero_jobs, {_K} % 5 < 3 AS healthy FROM events WHERE {_K} % 13 <> 0""")
def health_map(spark, d):
    e = table(spark, d, "events").withColumn("_k", _k())
    state = F.create_map(
        F.concat("event_type", F.col("event_id").cast("string")),
        F.struct(
            F.lit("2024-01-01").alias("last_run"), F.col("_k").alias("jobs_found"), F.lit(1.0).alias("http_success_rate"),
            (F.col("_k") % 5).alias("consecutive_zero_jobs"), (F.col("_k") % 5 < 3).alias("healthy"),
        ),
    )
    landed = e.select(F.when(F.col("_k") % 13 == 0, F.lit("[")).otherwise(F.to_json(state)).alias("value"))
    return stores.parse_keyed_map(landed, "value", stores.HEALTH_TYPE, "source")
