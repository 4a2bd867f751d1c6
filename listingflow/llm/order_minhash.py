"""Document fingerprints by Order MinHash (operator 6).

A text is its sequence of k-mers of code points, each numbered by its occurrence, so all
items differ. For each of ``SKETCHES`` permutations the ``TUPLE`` items with the smallest
values are taken, put back into text order and hashed together. Two fingerprints agree
in a position if the same items come in the same order, which falls with edit distance.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.words import STEP, mix

KMER, TUPLE, SKETCHES = 5, 2, 32
SEED = 11
_POSITION_BITS = np.uint64(24)


@functools.cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, SKETCHES, dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def occurrence_items(points: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each k-mer and its occurrence number, in text order. A text
    shorter than k is one item."""
    width = min(KMER, len(points))
    n = len(points) - width + 1
    kmers = np.zeros(n, np.uint64)
    for i in range(width):
        kmers = kmers * STEP + points[i : i + n]
    kmers = mix(kmers + np.uint64(width))
    if n < 1 << int(_POSITION_BITS):
        keyed = (kmers >> _POSITION_BITS << _POSITION_BITS) | np.arange(n, dtype=np.uint64)
        keyed.sort()
        order = (keyed & np.uint64((1 << int(_POSITION_BITS)) - 1)).astype(np.int64)
        sorted_kmers = keyed >> _POSITION_BITS
    else:
        order = np.argsort(kmers >> _POSITION_BITS, kind="stable")
        sorted_kmers = kmers[order] >> _POSITION_BITS
    place = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_kmers[1:] != sorted_kmers[:-1]
    numbers = np.empty(n, np.uint64)
    numbers[order] = (place - np.maximum.accumulate(np.where(fresh, place, 0))).astype(np.uint64)
    return mix((kmers >> _POSITION_BITS) + numbers * STEP)


def fingerprint(points: np.ndarray) -> np.ndarray:
    """``SKETCHES`` 32-bit hashes; zeros for an empty text."""
    if len(points) == 0:
        return np.zeros(SKETCHES, np.uint32)
    items = occurrence_items(points)
    x = (items >> np.uint64(32)).astype(np.uint32)
    a, b = _permutations()
    take = min(TUPLE, len(x))
    places = np.empty((SKETCHES, take), np.int64)
    together = max(1, (1 << 18) // len(x))
    for i in range(0, SKETCHES, together):
        values = a[i : i + together, None] * x[None, :] + b[i : i + together, None]
        rows = np.arange(len(values))
        for t in range(take):
            best = values.argmin(axis=1)
            places[i : i + together, t] = best
            values[rows, best] = np.uint32(0xFFFFFFFF)
    places.sort(axis=1)
    total = np.arange(1, SKETCHES + 1, dtype=np.uint64)
    for t in range(take):
        total = mix(total * STEP + items[places[:, t]])
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def sha256_of(points: np.ndarray) -> str:
    text = points.tobytes().decode("utf-32-le", "surrogatepass")
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def edited(points: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The second half replaced by as much of the next text's start, or all of it."""
    half = len(points) // 2
    return np.concatenate([points[: len(points) - half], following[:half]])


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``part, doc_id, text, more``: rows of each part sorted by doc_id lie together, in
    order, and each part ends with the row that follows it (``more`` false).

    Parts are ranges of doc_id cut at quantiles; the rows of equal doc_id are in one part,
    ordered by their text, and a null doc_id comes first. Only the first row of each part
    is copied, and what goes through the driver is a cut per part.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    quantiles = [i / n for i in range(1, n)] or [0.5]
    cuts = rows.agg(F.percentile_approx("doc_id", quantiles, max(10_000, 20 * n))).first()[0] or []
    cuts = sorted(set(cuts)) if n > 1 else []
    part = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        part = F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(part)
    placed = rows.withColumn("part", part.cast("int"))
    heads = placed.groupBy("part").agg(F.min("doc_id").alias("head"), F.count_if(F.col("doc_id").isNull()).alias("blank")).orderBy("part").collect()
    if not heads:
        return placed.select("part", "doc_id", "text", F.lit(True).alias("more"), F.lit(0).alias("late"))
    before = {heads[i]["part"]: heads[i - 1]["part"] for i in range(len(heads))}
    target = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    firsts = {h["part"]: None if h["blank"] else h["head"] for h in heads}
    known = [F.lit(x) for p, h in firsts.items() if h is not None for x in (p, h)]
    is_first = F.col("doc_id").isNull()
    if known:
        is_first = F.coalesce(F.element_at(F.create_map(*known), F.col("part")).eqNullSafe(F.col("doc_id")), F.lit(False)) | is_first
    own = F.struct(F.col("part"), F.lit(True).alias("more"), F.lit(0).alias("late"))
    copy = F.struct(target[F.col("part")].alias("part"), F.lit(False).alias("more"), F.lit(1).alias("late"))
    where = F.when(is_first, F.array(own, copy)).otherwise(F.array(own))
    spread = placed.select("doc_id", "text", F.explode(where).alias("w")).select("w.part", "doc_id", "text", "w.more", "w.late")
    return spread.repartitionById(heads[-1]["part"] + 1, F.col("part")).sortWithinPartitions("part", "late", "doc_id", "text")


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[list] = [[] for _ in names]
    held = None
    for batch in batches:
        for part, doc_id, text, more in zip(*(batch.column(c) for c in ("part", "doc_id", "text", "more"))):
            points = code_points(text.as_py())
            row = (part.as_py(), doc_id.as_py(), points, fingerprint(points))
            if held is not None and held[0] == row[0]:
                changed = edited(held[2], points)
                prints = fingerprint(changed)
                values = (
                    held[1], len(held[2]),
                    sha256_of(changed), as_text(held[3]), as_text(prints),
                    likeness(held[3], prints), likeness(held[3], row[3]),
                )
                for column, value in zip(out, values):
                    column.append(value)
            held = row if more.as_py() else None
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            out = [[] for _ in names]


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``.

    A null text is empty; an empty text has the fingerprint of zeros. Rows are taken in
    ascending doc_id, then text, null doc_ids first; the last is followed by the first, a
    single row by itself. Equal texts have equal fingerprints. An empty table gives no
    rows; other columns are not looked at.
    """
    return with_next(docs).mapInArrow(_described, _RESULT)
