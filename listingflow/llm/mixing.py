"""Mixing sources to target weights by Pfair scheduling (operator 9).

Each source is cut into blocks of documents, in a random order that depends on doc_id
alone. Block k of a source of weight w is released at slot floor(k / w) and due by slot
ceil((k + 1) / w); in every slot the released block with the earliest deadline runs. With
weights that sum to one each source stays within one block of its share at all times.

Windows follow from the weights as given: they are fractions of whole numbers, so nothing
is rounded and no deviation adds up. When a source has no blocks left, the weights of the
others are scaled up and a new phase begins. The driver sees one row for each source; the
schedule, a row for each block, is written by a task that holds no more than a count of
each source. No document is left out or repeated.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from listingflow.scratch import materialize

BLOCK = 64
PERIOD = 4096
#: Rows of one numbering group; only the number of groups depends on it.
GROUP_ROWS = 50_000


def quantize(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Weights as whole numbers that sum to ``period``, each at least 1 (largest remainders)."""
    total = math.fsum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    rest = period - sum(out.values())
    names = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s is None, s or ""))
    for s in names[:rest]:
        out[s] += 1
    return out


def whole(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def _order(sources: Mapping[str | None, object]) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is None, s or ""))


def pfair(parts: Sequence[int]) -> Iterator[int]:
    """Which of the ``parts`` each slot goes to, without end: the earliest deadline among
    released blocks."""
    period = sum(parts)
    ran = [0] * len(parts)
    waiting = [(0, -(-period // p), i) for i, p in enumerate(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, due, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i))
        _, i = heapq.heappop(ready)
        yield i
        ran[i] += 1
        k, p = ran[i], parts[i]
        heapq.heappush(waiting, (k * period // p, -(-(k + 1) * period // p), i))
        t += 1


def pfair_period(parts: Mapping[str | None, int], period: int) -> dict[str | None, list[int]]:
    """The slots of each source in one period of ``period`` slots, by earliest deadline
    among released blocks. ``parts`` sum to ``period``."""
    names = _order(parts)
    slots: dict[str | None, list[int]] = {s: [] for s in names}
    for t, i in zip(range(period), pfair([parts[s] for s in names])):
        slots[names[i]].append(t)
    return slots


def _left(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> dict[str | None, int]:
    left = {s: n for s, n in blocks.items() if n > 0}
    missing = [s for s in left if not weights.get(s, 0) > 0]
    if missing:
        raise ValueError(f"sources without a positive target weight: {missing}")
    return left


def schedule(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> Iterator[tuple[str | None, int]]:
    """``(source, block)`` of each slot. Within a phase, that is until a source runs out,
    each source stays within one block of its share of the weights left."""
    left = _left(blocks, weights)
    while left:
        names = _order(left)
        parts = whole({s: weights[s] for s in names})
        for i in pfair([parts[s] for s in names]):
            s = names[i]
            yield s, blocks[s] - left[s]
            left[s] -= 1
            if not left[s]:
                del left[s]
                break


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], period: int = PERIOD) -> list[tuple]:
    """Rows ``(source, first_block, end_block, start_slot, slots, period)``: the blocks of
    a source that run in a phase, the slot at which it begins, and the source's slots in
    the phase's period. Weights are rounded to parts of the period, which is repeated."""
    left = _left(blocks, weights)
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        size = max(period, 1 << (16 * len(left) - 1).bit_length())
        parts = quantize({s: weights[s] for s in left}, size)
        slots = pfair_period(parts, size)
        # The phase ends with the last block of the first source that runs out.
        length = min((n - 1) // parts[s] * size + slots[s][(n - 1) % parts[s]] + 1 for s, n in left.items())
        for s in list(left):
            cycles, into = divmod(length, size)
            ran = cycles * parts[s] + sum(t < into for t in slots[s])
            if ran:
                out.append((s, done[s], done[s] + ran, start, slots[s], size))
            done[s] += ran
            left[s] -= ran
            if left[s] == 0:
                del left[s]
        start += length
    return out


def temperature_weights(counts: Mapping[str | None, int], alpha: float = 0.5) -> dict[str | None, float]:
    """Target weights proportional to ``count ** alpha``: large sources lose weight."""
    return {s: n**alpha for s, n in counts.items()}


def source_counts(docs: DataFrame) -> dict[str | None, int]:
    """Rows of each source; a null source is a source of its own."""
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}


def _numbered(docs: DataFrame, rows: int) -> DataFrame:
    """``source, row, n``: each row of ``docs`` as a struct, and its place in its source's
    random order. The rows of a source are spread over many groups by the leading bits of
    their hash, so a source with a third of all rows is numbered by many tasks."""
    bits = max(1, math.ceil(math.log2(max(2, rows / GROUP_ROWS))))
    ties = [F.col(c) for c in docs.columns if c not in ("doc_id", "source")]
    placed = docs.select(
        "source", F.struct(*docs.columns).alias("row"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"),
        (F.xxhash64(*ties) if ties else F.lit(0)).alias("tie"),
    ).withColumn("g", F.shiftright("h", 64 - bits))
    sizes = placed.groupBy("source", "g").agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.withColumn(
        "before", F.sum("rows").over(W.partitionBy("source").orderBy("g").rowsBetween(W.unboundedPreceding, -1))
    ).select(F.struct("source", "g").alias("k"), F.coalesce("before", F.lit(0)).alias("before"))
    order = [F.col("h"), F.col("row.doc_id").asc_nulls_first(), F.col("tie")]
    ranked = placed.withColumn("i", F.row_number().over(W.partitionBy("source", "g").orderBy(*order)))
    return (
        ranked.withColumn("k", F.struct("source", "g")).join(before, "k")
        .select("source", "row", (F.col("before") + F.col("i") - 1).alias("n"))
    )


_PHASES = T.StructType(
    [
        T.StructField("_source", T.StringType()),
        T.StructField("_first", T.LongType()),
        T.StructField("_end", T.LongType()),
        T.StructField("_start", T.LongType()),
        T.StructField("_slots", T.ArrayType(T.LongType())),
        T.StructField("_size", T.LongType()),
    ]
)


def _pieces(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]):
    """The schedule in pieces, as rows ``source, block, slot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            sources, numbers, slot = [], [], 0
            for s, k in schedule(blocks, weights):
                sources.append(s)
                numbers.append(k)
                if len(sources) == 1 << 16:
                    yield piece(sources, numbers, slot)
                    slot += len(sources)
                    sources, numbers = [], []
            if sources:
                yield piece(sources, numbers, slot)

    def piece(sources: list[str | None], numbers: list[int], slot: int) -> pa.RecordBatch:
        slots = pa.array(range(slot, slot + len(sources)), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(sources, pa.string()), pa.array(numbers, pa.int64()), slots], names=["source", "block", "slot"])

    return run


def _slots(spark: SparkSession, blocks: Mapping[str | None, int], weights: Mapping[str | None, float], period: int | None) -> DataFrame:
    """``source, block, slot`` of all blocks."""
    if period is None:
        _left(blocks, weights)  # raises here, not in the task
        return materialize(spark.range(0, 1, 1, 1).mapInArrow(_pieces(blocks, weights), "source string, block long, slot long"), "schedule")
    turns = F.size("_slots")
    inside = F.col("block") - F.col("_first")
    slot = F.col("_start") + F.floor(inside / turns) * F.col("_size") + F.get("_slots", (inside % turns).cast("int"))
    table = spark.createDataFrame(phases(blocks, weights, period), _PHASES)
    return table.withColumn("block", F.explode(F.expr("sequence(_first, _end - 1)"))).select(F.col("_source").alias("source"), "block", slot.alias("slot"))


def placed(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int | None = None
) -> DataFrame:
    """``row, block, slot, position``: what ``mix`` adds, beside each row as a struct. No
    name of a column of ``docs`` can clash with these."""
    counts = source_counts(docs)
    rows = sum(counts.values())
    slots = _slots(docs.sparkSession, {s: -(-n // block) for s, n in counts.items()}, weights or temperature_weights(counts), period)
    key = F.struct(F.col("source").cast("string").alias("source"), "block").alias("k")
    numbered = _numbered(docs, rows).withColumn("block", F.floor(F.col("n") / block))
    position = F.col("slot") * block + F.col("n") % block
    return (
        numbered.withColumn("k", key)
        .join(slots.select(key, "slot"), "k")
        .select("row", "block", "slot", position.alias("position"))
    )


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int | None = None
) -> DataFrame:
    """``docs(doc_id, source, ...)`` with ``block`` and ``slot`` (of the block) and
    ``position`` (ascending in the mixed order, unique, with gaps after partial blocks).

    Without ``weights`` the sources are weighted by the square root of their size. With a
    ``period`` the weights are rounded to parts of it. Every row is placed once. Null and
    repeated doc_ids are ordered by their other columns; rows equal in all columns are
    interchangeable. A source without a positive weight raises an error; an empty table
    gives no rows. No column but doc_id and source decides anything else, and further
    columns are carried along; one named as a result raises an error, for which ``placed``
    is the way out.
    """
    taken = {"block", "slot", "position"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are results")
    return placed(docs, weights, block, period).select("row.*", "block", "slot", "position")


def in_mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """The rows of ``docs`` in mixed order: partitions are ranges of the position, sorted,
    so the files of a table written from them follow the schedule. Columns stay as they are,
    whatever their names."""
    return placed(docs, weights).repartitionByRange("position").sortWithinPartitions("position").select("row.*")
