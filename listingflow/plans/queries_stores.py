"""Round trips through files and tables, and rules that come as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingflow.operators import filters, merge
from listingflow.operators.scoring import score_listings
from listingflow.plans.driver_tables import LISTINGS_SQL, as_of, listings, table
from listingflow.plans.queries_listings import RULES, SCORED, WITH, _PROGRESS, _profile, _progress
from listingflow.plans.queries_texts import repo_metadata
from listingflow.plans.registry import ORACLES, query
from listingflow.scratch import materialize, scratch_path
from listingflow.sources import repos, stores
from listingflow.sources.json_arrays import read_split_array


@query("store_by_source", f"{WITH} SELECT ord, title, company, location, source FROM listings")
def store_by_source(spark, d):
    """Listings written by source and read back."""
    rows = listings(spark, d, description=False).select("ord", "title", "company", "location", "source")
    path = scratch_path(spark, "by-source")
    stores.write_store(rows, path, partition_by=["source"])
    return stores.read_store(spark, path, rows.schema)


@query("store_json", f"{WITH} SELECT title, company, location, url, source FROM listings")
def store_json(spark, d):
    """Listings written as JSON and read back with the listing columns."""
    names = ["title", "company", "location", "url", "source"]
    path = scratch_path(spark, "json")
    stores.write_json(listings(spark, d, description=False).select(*names), path)
    return spark.read.schema(stores.LISTING_SCHEMA).json(path).select(*names)


@query("append_scores", f"{SCORED} SELECT ord, score FROM scored")
def append_scores(spark, d):
    """Scores appended in two runs, the later posted first."""
    scored = score_listings(listings(spark, d, rules=RULES), _profile(spark, d), RULES, as_of(), posted="posted", body="body")
    # Written once: both runs read it.
    scored = materialize(scored.select("ord", "posted", "score"), "scored")
    path = scratch_path(spark, "scores")
    early = F.col("posted") < F.lit("1998-01-01").cast("date")
    stores.append_rows(scored.where(~early).drop("posted"), path)
    stores.append_rows(scored.where(early).drop("posted"), path)
    return stores.read_store(spark, path, "ord long, score double")


@query("report_file", f"""{WITH} SELECT CAST(ord AS VARCHAR) AS ord, coalesce(title, '') AS title, company, '' AS missing FROM listings""")
def report_file(spark, d):
    """A CSV report read back as text; a column that isn't there is blank."""
    path = scratch_path(spark, "report")
    stores.write_report(listings(spark, d, description=False), path, ["ord", "title", "company", "missing"])
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("progress_updates", f"""{WITH}, {_PROGRESS}, old AS (SELECT job_key, max(status) AS status FROM progress GROUP BY 1),
upd AS (SELECT job_key, arg_max('state' || (ord % 5), ord) AS status FROM keys WHERE posted >= DATE '1997-06-01' GROUP BY 1)
SELECT coalesce(u.job_key, o.job_key) AS job_key, coalesce(u.status, o.status) AS status, CASE WHEN u.job_key IS NOT NULL THEN 'new' ELSE 'old' END AS folder
FROM old o FULL JOIN upd u ON o.job_key = u.job_key""")
def progress_updates(spark, d):
    """Progress written, read, updated by later rows, written and read again."""
    base = listings(spark, d, description=False)
    old = _progress(base).groupBy("job_key").agg(F.max("status").alias("status")).withColumn("folder", F.lit("old"))
    first, second = scratch_path(spark, "progress"), scratch_path(spark, "progress")
    stores.write_progress(old, first)
    updates = base.where(F.col("posted") >= F.lit("1997-06-01").cast("date")).select(
        merge.progress_key().alias("job_key"), F.concat(F.lit("state"), (F.col("ord") % 5).cast("string")).alias("status"),
        F.lit("new").alias("folder"), "ord",
    )
    known = stores.read_keyed_lines(spark, first, stores.PROGRESS_TYPE, "job_key")
    stores.write_progress(stores.update_progress(known, updates), second)
    return stores.read_keyed_lines(spark, second, stores.PROGRESS_TYPE, "job_key")


@query("health_file", """SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run, count(*) AS jobs_found, count(*) % 3 AS consecutive_zero_jobs, count(*) % 3 < 2 AS healthy
FROM events GROUP BY 1""")
def health_file(spark, d):
    """Health state written and read back; the rate is null throughout."""
    state = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_run"), F.count(F.lit(1)).alias("jobs_found")
    )
    state = state.select(
        "*", F.lit(None).cast("double").alias("http_success_rate"), (F.col("jobs_found") % 3).alias("consecutive_zero_jobs"),
        (F.col("jobs_found") % 3 < 2).alias("healthy"),
    )
    path = scratch_path(spark, "health")
    stores.write_health(state, path)
    return stores.read_keyed_lines(spark, path, stores.HEALTH_TYPE, "source").drop("http_success_rate")


@query("drop_private", "SELECT o_orderkey AS ord, o_orderstatus AS status, 'p' AS p_ FROM orders")
def drop_private(spark, d):
    """Working columns are gone, others with an underscore stay."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.lit("x").alias("_note"), F.col("o_orderstatus").alias("status"), F.lit("p").alias("p_"), F.lit(1).alias("__n")
    )
    return merge.drop_private(rows)


@query("fetched_pages", "SELECT page_id, url, html FROM pages WHERE html <> '' AND html IS NOT NULL AND page_id % 3 <> 1 AND page_id % 5 <> 2")
def fetched_pages(spark, d):
    """Pages that came; some of the landed ones are blank and some missing."""
    html = F.when(F.col("page_id") % 3 == 1, F.lit("")).when(F.col("page_id") % 5 == 2, F.lit(None)).otherwise(F.col("html"))
    return filters.with_html(table(spark, d, "pages").withColumn("html", html))


@query("reject_by_table", f"""{WITH}, terms AS (SELECT DISTINCT lower(trim(p_name)) AS term FROM part WHERE p_size >= 49)
SELECT ord, title, company, CASE WHEN EXISTS (SELECT 1 FROM terms WHERE contains(lower(title), term) OR contains(lower(company), term)) THEN 'Blacklisted company/keyword match' END AS rejection_reason FROM listings""")
def reject_by_table(spark, d):
    """The term list is a table: names of large parts."""
    terms = table(spark, d, "part").where("p_size >= 49").select(F.col("p_name").alias("term"))
    return filters.flag_by_table(listings(spark, d, description=False), terms).select("ord", "title", "company", "rejection_reason")


@query("score_by_rule_tables", f"{SCORED} SELECT ord, score FROM scored")
def score_by_rule_tables(spark, d):
    """The score's term lists are read from rule files, the weight of roles with its default."""
    path = scratch_path(spark, "rules")

    def read(name, rules):
        schema = f"{name} string, pos int, term string"
        rows = spark.createDataFrame([(k, i, t) for k, terms in rules.items() for i, t in enumerate(terms)], schema)
        stores.write_json_arrays(rows, f"{path}/{name}", F.lit(0))
        return stores.read_rules(spark, f"{path}/{name}/*", f"{schema}, weight double", {"weight": RULES.role_weight})

    roles, lexicons = read("role", RULES.roles), read("category", RULES.lexicons)
    rules = stores.rules_from_tables(roles, lexicons, RULES.default_category, role_weight=roles.agg(F.max("weight")).first()[0])
    return score_listings(listings(spark, d, rules=rules), _profile(spark, d), rules, as_of(), posted="posted", body="body").select("ord", "score")


@query("json_arrays", f"{WITH} SELECT title, company, location, url, source FROM listings")
def json_arrays(spark, d):
    """Listings written as JSON array files of some thousand rows each and read back."""
    names = ["title", "company", "location", "url", "source"]
    path = scratch_path(spark, "arrays")
    rows = listings(spark, d, description=False)
    stores.write_json_arrays(rows.select("ord", *names), path, F.floor(F.col("ord") / 4096))
    return stores.read_json_array(spark, f"{path}/*").select(*names)


@query("profile_files", "SELECT item_id, text FROM benchmark")
def profile_files(spark, d):
    """Each profile written as a text file of its own and read back, the id from its path."""
    path = scratch_path(spark, "profiles")
    rows = table(spark, d, "benchmark").select("item_id", F.col("text").alias("value"))
    rows.repartition("item_id").write.partitionBy("item_id").option("lineSep", "\x00").text(path)
    read = stores.read_profiles(spark, f"{path}/*")
    return read.select(
        F.regexp_extract("profile_id", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"),
        F.rtrim("text", F.lit("\x00")).alias("text"),
    )


@query("repo_files", ORACLES["repo_projects"])
def repo_files(spark, d):
    """Repository metadata written as JSON array files, read back and made projects."""
    path = scratch_path(spark, "repos")
    meta = repo_metadata(spark, d)
    stores.write_json_arrays(meta, path, F.pmod(F.xxhash64("name"), F.lit(1 + meta.count() // 1000)))
    return repos.projects(repos.read_repos(spark, f"{path}/*"))


@query("json_array_ranges", f"{WITH} SELECT title, company, location, url, source FROM listings")
def json_array_ranges(spark, d):
    """Listings in files of one long line each, read back in byte ranges."""
    names = ["title", "company", "location", "url", "source"]
    path = scratch_path(spark, "lines")
    rows = listings(spark, d, description=False).select(F.to_json(F.struct(*names)).alias("value"))
    rows.write.option("lineSep", ", ").text(path)
    return read_split_array(spark, path, ", ".join(f"{c} string" for c in names))
