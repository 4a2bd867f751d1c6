"""What the two text classifiers share: the labelled sample, class counts of hashed
features and their log-count ratios.

A classifier is fitted on at most ``PER_CLASS`` labelled documents of each class, those
with the smallest hash of their doc_id; class weights restore the proportions of all
labels. The model has ``2 ** BITS`` hashed features, so its size doesn't depend on the
corpus and it travels to the tasks inside the function that scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.words import slices, texts_of, tidy
from listingflow.scratch import discard, materialize

PER_CLASS = 8_000
BITS = 20
#: Bytes of text whose features are found together; it bounds a task's memory.
SLICE = 1 << 19
#: A feature is kept if its class counts differ with this likelihood-ratio statistic and
#: its log-count ratio is at least this far from zero.
LEAST_G2, LEAST_DOCS, LEAST_RATIO = 20.0, 4, 0.5

#: Text array -> (row, feature) of every distinct feature of every text, sorted by row.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def held_out() -> F.Column:
    """Rows that no classifier learns from; a null doc_id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """``(doc_id, text, label)`` to learn from, and the weight of a document of each class.

    Held-out rows, null labels, labels other than 0 and 1 and contradicting labels of one
    doc_id are left out. Only ids of the sample are broadcast, at most ``2 * per_class``.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
    )
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {c: max(1.0, n / per_class) for c, n in totals.items()}
    some = [
        known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "label")
        for c in (0, 1)
    ]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = texts.join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    return materialize(sample, "sample"), weights


def _counter(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in slices(batches, "text", SLICE):
            rows, found = features(texts_of(batch, "text"))
            of = np.asarray(batch.column("label"))[rows]
            for c in (0, 1):
                counts[c] += np.bincount(found[of == c], minlength=1 << BITS)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["feature", "n0", "n1"]
        )

    return run


def _lister(features: Features, chosen: np.ndarray):
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows, found = features(texts_of(batch, "text"), place >= 0)
            ends = np.cumsum(np.bincount(rows, minlength=len(batch)))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(place[found]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], names=["doc_id", "label", "found"])

    return run


@dataclass
class Training:
    """Documents as lists of chosen features, ratios of these, labels and weights."""

    chosen: np.ndarray
    ratios: np.ndarray
    offsets: np.ndarray
    found: np.ndarray
    labels: np.ndarray
    weights: np.ndarray


def _told(d0: int, d1: int) -> F.Column:
    """Whether a feature of ``n0`` and ``n1`` documents tells classes of ``d0`` and ``d1``
    documents apart: likelihood ratio of two frequencies against a common one, and size of
    the log-count ratio."""
    rate = (F.col("n0") + F.col("n1")) / (d0 + d1)
    total = F.lit(0.0)
    for n, d in ((F.col("n0"), d0), (F.col("n1"), d1)):
        for seen, expected in ((n, rate * d), (d - n, (1 - rate) * d)):
            total = total + F.when(seen > 0, 2 * seen * F.ln(seen / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)
    ratio = F.ln((F.col("n1") + 1) / (d1 + 2)) - F.ln((F.col("n0") + 1) / (d0 + 2))
    return (total >= LEAST_G2) & (F.abs(ratio) >= LEAST_RATIO)


def prepare(docs: DataFrame, labels: DataFrame, label: str, features: Features) -> Training:
    """Class counts of all features over the sample, added up by Spark; the chosen
    features, their log-count ratios and the sample's feature lists come to the driver.
    Their size is bounded by the sample and the number of hashed features."""
    sample, class_weights = labelled_sample(docs, labels, label)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    d0, d1 = sizes.get(0, 0), sizes.get(1, 0)
    counts = (
        sample.mapInArrow(tidy(_counter(features)), "feature int, n0 long, n1 long")
        .groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(f"n0 + n1 >= {LEAST_DOCS}")
        .where(_told(d0, d1) if d0 and d1 else F.lit(False))
        .orderBy("feature")
        .toArrow()
    )
    chosen, n0, n1 = (counts.column(c).to_numpy() for c in ("feature", "n0", "n1"))
    ratios = np.log((n1 + 1) / (d1 + 2)) - np.log((n0 + 1) / (d0 + 2))
    lists = sample.mapInArrow(tidy(_lister(features, chosen)), "doc_id long, label int, found array<int>").orderBy("doc_id", "label").toArrow()
    discard(sample)
    found = lists.column("found").combine_chunks()
    targets = lists.column("label").to_numpy()
    return Training(
        chosen, ratios, np.asarray(found.offsets), np.asarray(found.flatten()), targets,
        np.array([class_weights[c] for c in targets.tolist()], float),
    )


SCORE = "_score"


def free_name(docs: DataFrame, name: str = SCORE) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scored(
    docs: DataFrame, features: Features, weights: np.ndarray, intercept: float, scale: float = 1.0, shift: float = 0.0,
    name: str = SCORE,
) -> DataFrame:
    """``docs`` with the further column ``name``: ``1 / (1 + exp(-(scale * margin + shift)))``,
    where the margin is the intercept and the weights of the text's distinct features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows, found = features(texts_of(batch, "text"), weights != 0)
            margins = intercept + np.bincount(rows, weights[found], minlength=len(batch))
            scores = 1 / (1 + np.exp(-np.clip(scale * margins + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of each row once."""
    keys = np.unique(rows.astype(np.int64) << BITS | found)
    return keys >> BITS, keys & ((1 << BITS) - 1)
