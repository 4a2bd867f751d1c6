"""Materialised intermediate tables in the cluster's shared checkpoint folder.

Iterative operators cut their lineage by writing a parquet table and reading it
back. The table lives below the folder named by ``spark.checkpoint.dir``, so it
survives lost executors. Where that setting is absent, a folder on the session's
default file system is taken; if that is a disk of one machine and the session is
not a local one, there is no safe place and ``scratch_root`` raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

LOCAL_ROOT = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables of this session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    hadoop = spark._jsc.hadoopConfiguration()
    return default_root(hadoop.get("fs.defaultFS", "file:///"), spark.sparkContext.master)


def default_root(default_fs: str, master: str) -> str:
    """The folder without a setting: below the default file system, unless that is local to each machine."""
    if not default_fs.startswith("file:"):
        return f"{default_fs.rstrip('/')}{LOCAL_ROOT}"
    if master.startswith("local[") or master == "local":
        return LOCAL_ROOT
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing has used yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    frame = spark.read.schema(df.schema).parquet(path)
    frame._scratch_path = path
    return frame


def materialize_observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict[str, object]]:
    """``materialize``, and aggregates over all rows that are taken while they are written:
    no second job reads them. Over no rows counts are zero and other aggregates null."""
    seen = Observation()
    frame = materialize(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    return frame, seen.get


def discard(*frames: DataFrame) -> None:
    """Delete tables written by ``materialize`` that nothing reads any more."""
    for frame in frames:
        path = frame.__dict__.get("_scratch_path")
        if path:
            spark = frame.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
