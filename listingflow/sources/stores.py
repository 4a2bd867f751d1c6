"""Reading and writing listing stores, progress, health, statistics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.defaults import (
    APPLIED_COLUMNS, FILTERED_COLUMNS, RECOMMENDED_COLUMNS, SCRAPED_COLUMNS,
)
from listingflow.functions.responses import acceptance_chance, block
from listingflow.functions.score import ScoreRules
from listingflow.functions.text import text_or_empty

LISTING_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "category", "title", "company", "location", "date", "job_id",
            "description", "url", "source", "keyword",
        )
    ]
)
SCORE_SCHEMA = (
    "title string, company string, category string, score double, reason string, "
    "role_score double, skills_score double, experience_score double, "
    "location_score double, recency_score double"
)
PROGRESS_TYPE = "map<string,struct<status:string,folder:string>>"
HEALTH_TYPE = (
    "map<string,struct<last_run:string,jobs_found:bigint,http_success_rate:double,"
    "consecutive_zero_jobs:bigint,healthy:boolean>>"
)
FETCH_STATS_DDL = (
    "queries bigint, pages_scraped bigint, jobs_found bigint, duplicates bigint, "
    "failed_requests bigint, early_stopped bigint, total_duration double, avg_duration double"
)
RUN_STATS_SCHEMA = (
    "date string, runtime_seconds double, total_scraped bigint, total_scored bigint, "
    f"recommended bigint, sources map<string,struct<{FETCH_STATS_DDL.replace(' bigint', ':bigint').replace(' double', ':double')}>>"
)


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.globStatus(hadoop_path) is not None and len(fs.globStatus(hadoop_path)) > 0


def _struct(schema: T.StructType | str) -> T.StructType:
    """A schema given as text is parsed here, where a session exists."""
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str = LISTING_SCHEMA) -> DataFrame:
    """JSON array files; a missing path gives an empty table, broken records are dropped.

    This is the interchange format. One file is one split, so large stores belong
    in parquet (``read_store``).
    """
    schema = _struct(schema)
    if not _path_exists(spark, path):
        return _empty(spark, schema)
    with_bad = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(with_bad)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return raw.where(F.col("_corrupt").isNull()).drop("_corrupt")


def write_json_arrays(df: DataFrame, path: str, group: Column) -> None:
    """Write rows as JSON array files, one for each ``group``: the form of ``read_json_array``.
    A file is made and read by one task, so groups are of bounded size."""
    rows = df.groupBy(group.alias("_group")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    rows.repartition("_group").write.mode("overwrite").partitionBy("_group").text(path)


def read_store(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Parquet table, or an empty one with the same columns where it does not exist yet."""
    schema = _struct(schema)
    if not _path_exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).parquet(path)


def write_store(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a parquet store; ``partition_by=["source"]`` lets readers skip sources."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows without touching those already written."""
    df.write.mode("append").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Each text file is one profile."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("profile_id"), F.col("value").alias("text")
    )


def parse_keyed_map(df: DataFrame, json_col: str, map_type: str, key_name: str) -> DataFrame:
    """A JSON object of structs becomes one row per key; text that is no such object gives none."""
    parsed = df.select(F.explode(F.from_json(F.col(json_col), map_type)).alias(key_name, "_v"))
    return parsed.select(key_name, "_v.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(job_key, status, folder) of a progress map; a missing file gives no rows."""
    schema = T.StructType.fromDDL("job_key string, status string, folder string")
    if not _path_exists(spark, path):
        return _empty(spark, schema)
    return parse_keyed_map(spark.read.text(path, wholetext=True), "value", PROGRESS_TYPE, "job_key")


def read_health(spark: SparkSession, path: str) -> DataFrame:
    """Health state by source; a missing or broken file gives no rows."""
    schema = T.StructType.fromDDL(
        "source string, last_run string, jobs_found bigint, http_success_rate double, "
        "consecutive_zero_jobs bigint, healthy boolean"
    )
    if not _path_exists(spark, path):
        return _empty(spark, schema)
    return parse_keyed_map(spark.read.text(path, wholetext=True), "value", HEALTH_TYPE, "source")


def write_keyed_map(df: DataFrame, path: str, key: str) -> None:
    """Write rows as JSON objects of one key each, a line for each row, by all tasks.

    ``read_keyed_lines`` reads them back; joined, the objects are the interchange map.
    """
    value = F.struct(*[F.col(c) for c in df.columns if c != key])
    df.select(F.to_json(F.create_map(F.col(key), value)).alias("value")).write.mode("overwrite").text(path)


def read_keyed_lines(spark: SparkSession, path: str, map_type: str, key: str) -> DataFrame:
    """Rows of ``write_keyed_map``; broken lines give none."""
    return parse_keyed_map(spark.read.text(path), "value", map_type, key)


def write_progress(progress: DataFrame, path: str) -> None:
    """Write (job_key, status, folder)."""
    write_keyed_map(progress.select("job_key", "status", "folder"), path, "job_key")


def write_health(health: DataFrame, path: str) -> None:
    """Write the health state by source."""
    fields = ("source", "last_run", "jobs_found", "http_success_rate", "consecutive_zero_jobs", "healthy")
    write_keyed_map(health.select(*fields), path, "source")


def update_progress(progress: DataFrame, updates: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Progress after status updates: of several updates of a key the last by ``ord``
    counts, and it replaces the key's earlier status. Combined before the one shuffle."""
    both = progress.select("job_key", "status", "folder", F.lit(None).cast("long").alias("_o")).unionByName(
        updates.select("job_key", "status", "folder", F.col(ord_col).cast("long").alias("_o"))
    )
    newest = F.max(F.struct(F.col("_o"), "status", "folder")).alias("s")
    return both.groupBy("job_key").agg(newest).select("job_key", "s.status", "s.folder")


def rules_from_tables(roles: DataFrame, lexicons: DataFrame, default_category: str, **weights) -> ScoreRules:
    """``ScoreRules`` of two rule tables, ``(role, pos, term)`` and ``(category, pos, term)``.

    A rule set is configuration and is read to the driver whole; term lists too long for
    that belong in ``filters.flag_by_table``.
    """

    def lists(table: DataFrame, name: str) -> dict[str, tuple[str, ...]]:
        out: dict[str, list[str]] = {}
        for row in table.select(name, "pos", "term").orderBy(name, "pos").collect():
            out.setdefault(row[name], []).append(row["term"])
        return {k: tuple(v) for k, v in out.items()}

    return ScoreRules(roles=lists(roles, "role"), lexicons=lists(lexicons, "category"), default_category=default_category, **weights)


def read_rules(spark: SparkSession, path: str, schema: T.StructType | str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A rule or configuration object with typed fields; absent ones take their default."""
    df = read_json_array(spark, path, schema)
    for name, value in (defaults or {}).items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def run_stats_row(totals: DataFrame, stats: DataFrame, runtime_seconds: Column) -> DataFrame:
    """The nested statistics row of one run: totals and per-source figures as a map.

    ``stats`` has one row per source; the map holds exactly those.
    """
    entries = stats.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.col("source").alias("key"),
                    F.struct(*[F.col(c) for c in stats.columns if c != "source"]).alias("value"),
                )
            )
        ).alias("m")
    ).scalar()
    return totals.select(
        F.col("date").cast("string").alias("date"),
        runtime_seconds.cast("double").alias("runtime_seconds"),
        "total_scraped", "total_scored", "recommended",
        entries.alias("sources"),
    )


def read_run_stats(spark: SparkSession, path: str) -> DataFrame:
    """Run statistics from JSON; a single object counts as a list of one."""
    return read_json_array(spark, path, RUN_STATS_SCHEMA)


def report_frame(df: DataFrame, columns: Sequence[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Exactly the columns of a report as text; absent and null values are blank."""
    source_of = renamed or {}
    out = []
    for c in columns:
        src = source_of.get(c, c)
        value = F.col(src).cast("string") if src in df.columns else F.lit("")
        out.append(F.coalesce(value, F.lit("")).alias(c))
    return df.select(*out)


def scraped_report(listings: DataFrame) -> DataFrame:
    return report_frame(listings, SCRAPED_COLUMNS)


def filtered_report(rejected: DataFrame) -> DataFrame:
    return report_frame(rejected, FILTERED_COLUMNS)


def recommended_report(recommended: DataFrame) -> DataFrame:
    return report_frame(recommended, RECOMMENDED_COLUMNS, {"score_reason": "reason"})


def applied_report(applied: DataFrame) -> DataFrame:
    return report_frame(applied, APPLIED_COLUMNS)


def write_report(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Write a CSV report with a header. Quotes inside values are doubled."""
    frame = report_frame(df, columns) if columns else df
    frame.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)


def application_rows(rows: DataFrame, response: str, as_of: Column) -> DataFrame:
    """One row per application: match in percent, preparation text, chance, status, day."""
    return rows.select(
        text_or_empty("title").alias("title"),
        text_or_empty("company").alias("company"),
        (F.col("score") * 10).alias("match_pct"),
        block(response, "INTERVIEW_PREP").alias("prep"),
        acceptance_chance(response).alias("chance"),
        F.lit("Applied").alias("status"),
        F.date_format(as_of, "yyyy-MM-dd").alias("date"),
    )


def checkpoint_summary(listings: DataFrame, rejected: DataFrame) -> DataFrame:
    """Counts of a run per source, to append after it."""
    rows = listings.select("source", F.lit(1).alias("j"), F.lit(0).alias("r")).unionAll(
        rejected.select("source", F.lit(0).alias("j"), F.lit(1).alias("r"))
    )
    return rows.groupBy("source").agg(
        F.sum("j").alias("jobs_found"), F.sum("r").alias("rejected")
    )
