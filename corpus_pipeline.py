"""A training corpus from raw documents: each stage keeps, orders or packs what the stage
before it kept, and is written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingflow.llm.minhash import without_near_duplicates
from listingflow.llm.mixing import in_mixed_order, placed
from listingflow.llm.packing import pack
from listingflow.llm.quality import only_good
from listingflow.llm.queries import TOKENIZER, table
from listingflow.llm.ship import ship
from listingflow.llm.toxicity import without_toxic
from listingflow.plans.registry import query
from listingflow.scratch import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return only_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule that gives each source its weight."""
    ship(spark)
    return in_mixed_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of bounded length that follow the schedule.
    A table that is read again has no order; the place of each document is a function of
    the rows alone, so it is found again here."""
    ship(spark)
    return pack(placed(docs).select("row.doc_id", "row.text", "position"), TOKENIZER, "position")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Classifiers and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
