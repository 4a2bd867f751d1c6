"""Toxicity: character n-grams with naive Bayes log-count ratios (operator 3).

The features of a text are its distinct n-grams of 3 to 5 characters (lower case, white
space as one space), hashed. A feature's value is its naive Bayes log-count ratio, and a
logistic regression on these values gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.linear import BITS, SCORE, Training, distinct, free_name, prepare, scored
from listingflow.llm.words import STEP, mix

SIZES = (3, 4, 5)
#: Strength of the quadratic penalty, and steps of the fit.
PENALTY, STEPS = 1.0, 200
CUT = 0.5


#: Code points of a text, or of several, that are looked at together.
BLOCK = 1 << 18


def ngrams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of every distinct n-gram; with ``wanted`` only of those."""
    plain = pc.utf8_lower(pc.replace_substring_regex(pc.utf8_trim_whitespace(texts), r"\s+", " "))
    # A text border is a code point that no text has.
    joined = "\udc80".join(["", *plain.to_pylist(), ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first_row, rows, found = 0, [], []
    # Blocks overlap, so every n-gram lies in the block in which it begins.
    for start in range(0, len(points), BLOCK):
        some = points[start : start + BLOCK + max(SIZES) - 1]
        border = some == 0xDC80
        row = (np.cumsum(border) - 1 + first_row).astype(np.int32)
        block_rows, block_found = [], []
        for size in SIZES:
            n = max(min(len(some) - size + 1, BLOCK), 0)
            total = np.zeros(n, np.uint64)
            inside = np.ones(n, bool)
            for i in range(size):
                total = total * STEP + some[i : i + n]
                inside &= ~border[i : i + n]
            feature = (mix(total + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int32)
            if wanted is not None:
                inside &= wanted[feature]
            block_rows.append(row[:n][inside])
            block_found.append(feature[inside])
        first_row += int(np.count_nonzero(border[:BLOCK]))
        r, f = distinct(np.concatenate(block_rows), np.concatenate(block_found))
        rows.append(r)
        found.append(f)
    return distinct(np.concatenate(rows), np.concatenate(found)) if len(rows) > 1 else (rows[0], found[0])


def fit(data: Training) -> tuple[np.ndarray, float]:
    """Weights of the ratio-scaled features and the intercept, by accelerated gradient
    steps on the weighted logistic loss."""
    n, width = len(data.labels), len(data.chosen)
    if n == 0 or data.labels.min() == data.labels.max():
        return np.zeros(width), 0.0 if n == 0 else (4.0 if data.labels[0] else -4.0)
    value = data.ratios[data.found]
    row = np.repeat(np.arange(n), np.diff(data.offsets))
    share = data.weights / data.weights.sum()
    target = data.labels.astype(float)
    size = np.bincount(row, value * value, minlength=n) + 1
    rate = 4 / (share * size).sum() / 4
    w, b = np.zeros(width), float(np.log((share @ target) / (1 - share @ target)))
    momentum, mb, t = w.copy(), b, 1.0
    # Steps are per feature (diagonal scaling): frequent features move slower.
    curve = 0.25 * np.bincount(data.found, value * value * share[row] * np.sqrt(size[row]), minlength=width) + PENALTY / n
    for _ in range(STEPS):
        margin = np.bincount(row, momentum[data.found] * value, minlength=n) + mb
        error = share * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target)
        gradient = np.bincount(data.found, value * error[row], minlength=width) + PENALTY / n * momentum
        w2, b2 = momentum - gradient / curve, mb - min(rate, 1.0) * error.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, mb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, float]:
    """Weight of every hashed feature (zero for those not chosen) and the intercept."""
    data = prepare(docs, labels, label, ngrams)
    w, b = fit(data)
    weights = np.zeros(1 << BITS)
    weights[data.chosen] = w * data.ratios
    return weights, b


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` as doc_id, score, predicted: one row per row.

    Scores whole texts; a null or empty text has the score of the intercept. Without
    labels of both classes every text has the same score, near the one class if there is
    one. Repeated rows have equal scores; labels without a document, contradicting labels
    and null labels teach nothing. An empty table gives no rows; other columns are not
    looked at.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = scored(rows, ngrams, *model).select("doc_id", F.col(SCORE).alias("score"))
    return result.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    name = free_name(docs)
    return scored(docs, ngrams, *train(docs, labels), name=name).where(F.col(name) < CUT).drop(name)
