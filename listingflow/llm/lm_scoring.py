"""LM scoring by cross-entropy difference (operator 2).

Two word bigram models, one of a target collection and one of all documents (the
background), share one vocabulary and one smoothing, scaled to their sizes so that they
match. A document's score is the mean over its words of target loss less background loss:
below zero where it looks more like the target.

All words of all documents are counted, each bigram by itself (words are 64-bit hashes).
Tasks count within slices of their input and Spark sums the counts, in a table that grows
with the corpus; words and histories are sums over it. Each distinct bigram's losses are
worked out once. The most frequent bigrams go to all tasks, ``HOT`` at most; the others of
each document are joined with the table, and none of these is frequent enough to load one
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.linear import held_out
from listingflow.llm.words import STEP, mix, slices, texts_of, word_hashes
from listingflow.scratch import discard, materialize

#: Words for which the prior has mass, in powers of two; more if there are more.
WORD_BITS = 18
#: Prior counts for a model of the target's size: of each word, and of each history.
WORD_PRIOR, PAIR_PRIOR = 0.1, 50.0
#: Bigrams whose losses are sent to all tasks, 24 bytes each.
HOT = 1 << 20

#: The history of a text's first word.
_START = 0


def _pairs_of(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = mix(history.view(np.uint64) + STEP) * STEP + word.view(np.uint64)
    return mix(key).view(np.int64)


def _events(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of texts, and of each word its hash, its history's and the pair's."""
    offsets, hashes = word_hashes(texts)
    word = hashes.view(np.int64)
    history = np.empty_like(word)
    history[1:] = word[:-1]
    history[offsets[:-1][offsets[:-1] < len(word)]] = _START
    return offsets, word, history, _pairs_of(history, word)


_COUNTS = "history long, word long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        _, word, history, pair = _events(texts_of(batch, "text"))
        _, first, n = np.unique(pair, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(history[first]), pa.array(word[first]), pa.array(n)], names=["history", "word", "n"])


def count(docs: DataFrame) -> DataFrame:
    """``(history, word, n)`` over all rows, with repetitions that are to be summed."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, _COUNTS)


_LOSSES = "pair long, n long, target double, background double"


def _losses(totals: tuple[int, int], vocabulary: int):
    """Negative log probability of each word after its history, in both models."""
    size = max(1.0, float(totals[0]))
    scales = (1.0, max(1.0, totals[1] / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(name).to_numpy()
            out = []
            for side, total, scale in zip(("t", "b"), totals, scales):
                plain = (column(f"words_{side}") + WORD_PRIOR * scale) / (total + WORD_PRIOR * scale * vocabulary)
                prior = PAIR_PRIOR * scale
                out.append(-np.log((column(f"n_{side}") + prior * plain) / (column(f"histories_{side}") + prior)))
            pair = _pairs_of(column("history"), column("word"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair), batch.column("n_b"), *map(pa.array, out)], names=["pair", "n", "target", "background"]
            )

    return run


def losses(target: DataFrame, docs: DataFrame) -> DataFrame:
    """``pair, n, target, background``: each bigram of ``docs`` with its count there and
    its losses, written once."""
    none = F.lit(0).cast("long")
    both = (
        count(target).select("history", "word", F.col("n").alias("n_t"), none.alias("n_b"))
        .unionByName(count(docs).select("history", "word", none.alias("n_t"), F.col("n").alias("n_b")))
    )
    bigrams = materialize(both.groupBy("history", "word").agg(F.sum("n_t").alias("n_t"), F.sum("n_b").alias("n_b")), "bigrams")

    def sums(key: str, name: str) -> DataFrame:
        return bigrams.groupBy(key).agg(F.sum("n_t").alias(f"{name}_t"), F.sum("n_b").alias(f"{name}_b"))

    words = materialize(sums("word", "words"), "words")
    whole = words.agg(F.sum("words_t"), F.sum("words_b"), F.count(F.lit(1))).first()
    vocabulary = max(1 << WORD_BITS, whole[2])
    table = bigrams.where("n_b > 0").join(words, "word").join(sums("history", "histories"), "history")
    out = materialize(table.mapInArrow(_losses((whole[0] or 0, whole[1] or 0), vocabulary), _LOSSES), "losses")
    discard(bigrams, words)
    return out


def _least_hot(table: DataFrame) -> int:
    """The count, a power of two, from which at most ``HOT`` bigrams have as many. A bigram
    with fewer than that is at most ``2 / HOT`` of all words."""
    kinds = table.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows")).collect()
    rows, least = 0, 64
    for k, n in sorted(((r["k"], r["rows"]) for r in kinds), reverse=True):
        rows += n
        if rows > HOT:
            break
        least = k
    return 1 << min(least, 62)


_SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_OPEN = "row long, doc_id long, n_tokens long, target double, background double, pair long, often int"


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_tokens, target_loss,
    background_loss, score (means over the words, natural logarithms).

    A null or empty text has no words: its losses and score are null. With an empty target
    its model is the smoothing alone. Repeated rows have equal scores; an empty table gives
    no rows; other columns are not looked at. ``target(text, ...)`` is a collection, such as
    all curated documents; its texts may be among the documents.
    """
    table = losses(target, docs)
    least = _least_hot(table)
    hot = table.where(F.col("n") >= least).select("pair", "target", "background").toArrow()
    order = np.argsort(hot.column("pair").to_numpy(), kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy()[order] for c in ("pair", "target", "background")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *known_losses = shared.value
        # Numbers that no other task uses; they are read back from the written table.
        row = TaskContext.get().partitionId() << 36
        schema = pa.schema([(c, {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}[k]) for c, k in (f.split() for f in _OPEN.split(", "))])
        for batch in slices(batches, "text"):
            offsets, _, _, pair = _events(texts_of(batch, "text"))
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            here = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.bincount(owner[here], x[at[here]], minlength=len(n)) for x in known_losses]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(len(n))), batch.column("doc_id"), pa.array(n), *map(pa.array, sums),
                    pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32()),
                ],
                schema=schema,
            )
            owner, pair = owner[~here], pair[~here]
            order = np.lexsort((pair, owner))
            owner, pair = owner[order], pair[order]
            starts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.empty(0, np.int64)
            often = np.diff(np.append(starts, len(pair)))
            for i in range(0, len(starts), 1 << 16):
                some = starts[i : i + (1 << 16)]
                blank = [pa.nulls(len(some), f.type) for f in list(schema)[1:5]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + owner[some]), *blank, pa.array(pair[some]), pa.array(often[i : i + (1 << 16)].astype(np.int32))], schema=schema
                )
            row += len(n)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    opened = materialize(rows.mapInArrow(run, _OPEN), "opened")
    others = (
        opened.where("pair is not null").select("row", "pair", "often")
        .join(table.where(F.col("n") < least).select("pair", "target", "background"), "pair")
        .select(
            "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"),
            (F.col("often") * F.col("target")).alias("target"), (F.col("often") * F.col("background")).alias("background"),
        )
    )
    whole = opened.where("pair is null").select("row", "doc_id", "n_tokens", "target", "background").unionByName(others)
    mean = lambda c: F.sum(c) / F.when(F.max("n_tokens") > 0, F.max("n_tokens"))
    return (
        whole.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), mean("target").alias("target_loss"), mean("background").alias("background_loss"))
        .select("doc_id", "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
    )


def curated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All documents labelled good and not toxic."""
    ids = (
        labels.where("quality = 1 and toxic = 0")
        .select(F.col("doc_id").cast("long"))
        .where(F.col("doc_id").isNotNull() & ~held_out())
        .distinct()
    )
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(ids, "doc_id", "left_semi")
