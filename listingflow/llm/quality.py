"""Quality classifier: naive Bayes support vectors (operator 7).

Features are indicators of n-grams over two views of a text's words: the words themselves
without case and outer punctuation (one and two words), and their shapes (case, digits,
outer punctuation, whether a word repeats the one before; one to three words). Indicators
are scaled by their class log-count ratios, and a linear hinge-loss model is fitted by
dual coordinate descent. Margins of documents that the fit left out turn a margin into a
score by a logistic curve.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.linear import BITS, SCORE, Training, distinct, free_name, prepare, scored
from listingflow.llm.words import STEP, mix, split_words

#: Bound of the dual variables (times a document's weight), and passes over the sample.
COST, ROUNDS = 0.1, 20
#: Every so many-th document of the sample calibrates instead of fitting.
CALIBRATE = 5
CUT = 0.3
SEED = 3

_CORE = re.compile(r"[^\W_]+(?:.*[^\W_])?", re.S)
_DIGIT = re.compile(r"\d")


@functools.lru_cache(maxsize=1 << 16)
def _described(word: str) -> tuple[int, int]:
    """Hashes of a word without case and outer punctuation, and of its shape."""
    core = _CORE.search(word)
    inner = core.group() if core else ""
    end = word[core.end() :] if core else word
    case = "u" if inner.isupper() and len(inner) > 1 else "l" if inner.islower() else "t" if inner.istitle() else "m" if inner else "-"
    digits = _DIGIT.search(inner) is not None
    shape = f"{case}{digits:d}{min(len(inner), 24) // 8}{word[: core.start()][:2] if core else ''} {end[:3]}"
    return xxhash.xxh3_64_intdigest(inner.lower()), xxhash.xxh3_64_intdigest(shape)


def ngrams(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, feature)`` of every distinct n-gram; with ``wanted`` only of those."""
    offsets, index, words = split_words(texts, lower=False)
    table = np.array([_described(w) for w in words.to_pylist()], np.uint64).reshape(-1, 2)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    core, shape = table[index, 0], table[index, 1]
    again = np.zeros(len(core), bool)
    again[1:] = (core[1:] == core[:-1]) & (row[1:] == row[:-1])
    shape = shape + again.astype(np.uint64)
    rows, found = [], []
    for view, values in enumerate((core, shape)):
        for size in range(1, 3 + view):
            n = max(len(values) - size + 1, 0)
            total = np.zeros(n, np.uint64)
            for i in range(size):
                total = total * STEP + values[i : i + n]
            feature = (mix(total + np.uint64(8 * view + size)) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = row[:n] == row[size - 1 : size - 1 + n]
            if wanted is not None:
                inside &= wanted[feature]
            rows.append(row[:n][inside])
            found.append(feature[inside])
    return distinct(np.concatenate(rows), np.concatenate(found))


def descend(data: Training, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias feature of one."""
    width = len(data.chosen)
    w, bias = np.zeros(width), 0.0
    alpha = np.zeros(len(data.labels))
    bound = COST * data.weights
    docs = [data.found[data.offsets[i] : data.offsets[i + 1]] for i in range(len(data.labels))]
    square = data.ratios**2
    size = np.array([square[d].sum() + 1 for d in docs])
    sign = np.where(data.labels == 1, 1.0, -1.0)
    rng = np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in rng.permutation(used):
            d = docs[i]
            r = data.ratios[d]
            slope = sign[i] * (w[d] @ r + bias) - 1
            after = min(max(alpha[i] - slope / size[i], 0.0), bound[i])
            step = (after - alpha[i]) * sign[i]
            if step:
                w[d] += step * r
                bias += step
                alpha[i] = after
                moved = max(moved, abs(step) * size[i])
        if moved < 1e-3:
            break
    return w, bias


def curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic curve through the margins (Newton steps on targets
    that are drawn in a little from 0 and 1)."""
    ones, zeros = weights[labels == 1].sum(), weights[labels == 0].sum()
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weights * (p - target)) + 1e-3 * (theta - [1, 0])
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step / max(1.0, np.abs(step).max())
    return max(float(theta[0]), 1e-3), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float, float, float]:
    """Weight of every hashed feature, intercept, and the scale and shift of the score."""
    data = prepare(docs, labels, label, ngrams)
    n = len(data.labels)
    if n == 0 or data.labels.min() == data.labels.max():
        return np.zeros(1 << BITS), 0.0 if n == 0 else (4.0 if data.labels[0] else -4.0), 1.0, 0.0
    turn = np.arange(n) % CALIBRATE == 0
    w, bias = descend(data, np.flatnonzero(~turn))
    value = np.concatenate([w * data.ratios, [0.0]])
    row = np.repeat(np.arange(n), np.diff(data.offsets))
    margins = np.bincount(row, value[data.found], minlength=n) + bias
    scale, shift = curve(margins[turn], data.labels[turn], data.weights[turn])
    weights = np.zeros(1 << BITS)
    weights[data.chosen] = w * data.ratios
    return weights, bias, scale, shift


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
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


def only_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    name = free_name(docs)
    return scored(docs, ngrams, *train(docs, labels), name=name).where(F.col(name) >= CUT).drop(name)
