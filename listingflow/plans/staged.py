"""A run in stages that goes on where an earlier one ended."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.defaults import MIN_SCORE, TARGET_LISTINGS
from listingflow.functions.score import ScoreRules
from listingflow.operators.dedup import kept_ords, listing_keys
from listingflow.operators.filters import at_least, split_rejected
from listingflow.operators.keys import pick_rows
from listingflow.operators.scoring import score_listings
from listingflow.operators.topk import ranked_top


class Stopped(Exception):
    """The run was asked to end after a stage."""


def content_id(df: DataFrame) -> str:
    """A digest of a table's rows in any order, with their repetitions, and of its columns."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    sums = df.select(F.xxhash64(row).alias("h"), F.xxhash64(F.lit(1), row).alias("g")).agg(
        F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))
    )
    return hashlib.sha256(repr((sorted(df.dtypes), [str(v) for v in sums.first()])).encode()).hexdigest()


class Stages:
    """The stages of a run below ``path``.

    A stage's folder is named after its inputs, parameters and the stages it reads, so what
    an earlier run finished is found by a later one with the same inputs and by no other. A
    stage is finished when its write was committed; what a run that died left behind is
    overwritten. ``done`` lists the stages that were found, ``made`` those that were written.
    """

    def __init__(self, spark: SparkSession, path: str, inputs: Sequence[str], stop_after: str | None = None) -> None:
        self.spark, self.path, self.stop_after = spark, path.rstrip("/"), stop_after
        self.ids = {"": hashlib.sha256(repr(tuple(inputs)).encode()).hexdigest()}
        self.done: list[str] = []
        self.made: list[str] = []

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{self.ids[name][:32]}"

    def _committed(self, name: str) -> bool:
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder(name), "_SUCCESS")
        return marker.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(marker)

    def stage(self, name: str, build: Callable[[], DataFrame], reads: Sequence[str] = (), parameters: Sequence[object] = ()) -> DataFrame:
        """The table of a stage: read if an earlier run finished it, else built and written."""
        told = (name, [self.ids[r] for r in (reads or ("",))], [repr(p) for p in parameters])
        self.ids[name] = hashlib.sha256(repr(told).encode()).hexdigest()
        if self._committed(name):
            self.done.append(name)
        else:
            build().write.mode("overwrite").parquet(self.folder(name))
            self.made.append(name)
        if name == self.stop_after:
            raise Stopped(name)
        return self.spark.read.parquet(self.folder(name))


def staged_run(
    listings: DataFrame,
    profile: DataFrame,
    rules: ScoreRules,
    as_of: Column,
    path: str,
    blacklist: Sequence[str] = (),
    min_score: float = MIN_SCORE,
    target: int = TARGET_LISTINGS,
    posted: str = "posted",
    stop_after: str | None = None,
    body: str | None = None,
    bodies: DataFrame | None = None,
    text_id: str = "doc_id",
) -> tuple[DataFrame, Stages]:
    """Deduplicate, reject, score and recommend, each stage written below ``path``.

    A run that died, or that ``stop_after`` ended with ``Stopped``, goes on after its last
    finished stage when it is called again. Returns the recommended rows with ``rank``, and
    the stages. ``body`` is that of ``score_listings``; with ``bodies``, of which each
    ``text_id`` has its ``body``, listings carry the ``text_id`` alone up to the scores.
    """
    inputs = [content_id(listings), content_id(profile), str(as_of)]
    if bodies is not None:
        inputs.append(content_id(bodies))
    stages = Stages(listings.sparkSession, path, inputs, stop_after)
    unique = stages.stage("unique", lambda: kept_ords(listings, listing_keys()))
    kept = stages.stage(
        "kept", lambda: split_rejected(pick_rows(listings, unique), blacklist)[0], ["unique"], [tuple(blacklist)]
    )
    described = kept if bodies is None else kept.join(bodies, text_id).drop(text_id)
    scored = stages.stage("scored", lambda: score_listings(described, profile, rules, as_of, posted=posted, body=body), ["kept"], [rules, posted])
    best = stages.stage("recommended", lambda: ranked_top(at_least(scored, min_score), target), ["scored"], [min_score, target])
    return best, stages
