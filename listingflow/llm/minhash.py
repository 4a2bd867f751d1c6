"""Near-duplicate documents by min-max hashing (operator 4).

Under each permutation of the shingles both the smallest and the largest value are
kept, so a signature of 250 values costs 125 permutations. Bands of signature values
propose pairs; every link is confirmed on the two whole shingle sets.

All pairs of a bucket are decided, but not all are listed. Equal word sequences count as
one document from the start. In each bucket every member is first compared with the
smallest one (the hub). What these links join needs no further comparison. The members of
a hub's buckets that are still apart from it are then compared with each other and with
the rest, block by block inside tasks, which return no pairs but the components they find.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.graph import components
from listingflow.llm.words import STEP, mix, runs, slices, texts_of, tidy, word_hashes
from listingflow.scratch import discard, materialize

SHINGLE_WORDS = 5
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75 ** 5) ** 50 = 1.3e-6.
BANDS, ROWS = 50, 5
SEED = 7

_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"
_SETS = "doc_id long, shingles array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text, the hashes of its words and its sorted distinct shingle hashes."""
    offsets, hashes = word_hashes(texts)
    wide = runs(hashes, SHINGLE_WORDS)
    for start, end in zip(offsets[:-1], offsets[1:]):
        words = hashes[start:end]
        if len(words) == 0:
            yield words, words
        elif len(words) < SHINGLE_WORDS:
            yield words, runs(words, len(words))
        else:
            yield words, np.unique(wide[start : end - SHINGLE_WORDS + 1])


@functools.cache
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value of the set under each permutation, next to each other."""
    a, b = _permutations(BANDS * ROWS // 2)
    low = high = None
    for i in range(0, len(shingles), 4096):
        x = (shingles[i : i + 4096] >> np.uint64(32)).astype(np.uint32)
        values = a * x[None, :] + b
        least, most = values.min(axis=1), values.max(axis=1)
        low = least if low is None else np.minimum(low, least)
        high = most if high is None else np.maximum(high, most)
    return np.stack([low, high], axis=1).ravel()


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = total * STEP + rows[:, i]
    return mix(total).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, digests, bands = [], [], []
        for words, shingles in shingle_sets(texts_of(batch, "text")):
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(words.tobytes()) if len(words) else None)
            bands.append(band_keys(signature(shingles)) if len(words) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


#: Bits of the filter that tells which documents' shingles are needed, 8 MB in all. It
#: only saves work: what it lets through beyond the wanted ids joins nothing.
FILTER_BITS = 26
#: Shingles and documents of a block of documents that are compared in one task, and
#: documents that are compared with all others of two blocks at a time.
BLOCK_SHINGLES, BLOCK_DOCS, TILE = 1 << 17, 2000, 256
_WANTED = "word int, bits long"


def _places(ids: np.ndarray) -> np.ndarray:
    hashed = mix(ids.astype(np.int64).view(np.uint64) + STEP)
    low = np.uint64((1 << FILTER_BITS) - 1)
    return np.stack([hashed & low, (hashed >> np.uint64(32)) & low]).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = _places(np.asarray(batch.column("doc_id"))).ravel()
        word, bit = places >> 6, np.uint64(1) << (places & 63).astype(np.uint64)
        distinct, index = np.unique(word, return_inverse=True)
        bits = np.zeros(len(distinct), np.uint64)
        np.bitwise_or.at(bits, index, bit)
        yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of non-null ids; its size doesn't depend on theirs."""
    table = ids.mapInArrow(_marked, _WANTED).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, shingles)`` of all documents in ``ids``, and of few others. The texts are
    read again where they are; they aren't shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("doc_id")))
            first, second = _places(np.asarray(batch.column("doc_id")))
            there = lambda p: words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)
            wanted = (there(first) & there(second)).astype(bool)
            for part in slices(iter([batch.filter(pa.array(wanted))]), "text"):
                sets = [s.view(np.int64) for _, s in shingle_sets(texts_of(part, "text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return materialize(texts.mapInArrow(tidy(run), _SETS), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose whole shingle sets are similar enough."""
    left = sets.select(F.struct(F.col("doc_id").alias("a")).alias("_a"), F.col("shingles").alias("sa"))
    right = sets.select(F.struct(F.col("doc_id").alias("b")).alias("_b"), F.col("shingles").alias("sb"))
    both = (
        pairs.withColumn("_a", F.struct("a"))
        .join(left, "_a")
        .withColumn("_b", F.struct("b"))
        .join(right, "_b")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    )
    return materialize(both.where(f"100L * common >= {percent}L * (na + nb - common)").select("a", "b"), "links")


def _near(n: str, m: str, percent: int) -> str:
    """Sizes that allow the wanted similarity."""
    return f"100L * least({n}, {m}) >= {percent}L * greatest({n}, {m})"


def overlaps(sets: list[np.ndarray], tile: int = TILE) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of the intersections of pairs of sets: of ``tile`` sets at a time with all."""
    lengths = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), lengths)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection with another.
    common = often[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(1, (1 << 22) // max(1, len(sets)))
    for start in range(0, len(sets), tile):
        stop = min(start + tile, len(sets))
        out = np.zeros((stop - start, len(sets)), np.float32)
        # Only the shingles of these sets count.
        mine = (row >= start) & (row < stop)
        used = np.zeros(int(column[-1]) + 1 if len(column) else 0, bool)
        used[column[mine]] = True
        kept = used[column] if len(column) else mine
        place = np.cumsum(used) - 1
        rows, columns = row[kept], place[column[kept]]
        for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, wide):
            a, b = np.searchsorted(columns, [first, first + wide])
            hits = np.zeros((len(sets), min(wide, int(columns[-1]) + 1 - first)), np.float32)
            hits[rows[a:b], columns[a:b] - first] = 1
            out += hits[start:stop] @ hits.T
        out[np.arange(stop - start), np.arange(start, stop)] = lengths[start:stop]
        yield start, out


def _joined(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Each document with the smallest one it is joined with by links among these."""
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = np.zeros((len(sets), len(sets)), bool)
    for start, common in overlaps(sets):
        mine = slice(start, start + len(common))
        linked[mine] = (100 * common >= percent * (sizes[mine, None] + sizes[None, :] - common)) & (common > 0)
    label = ids.copy()
    while True:
        low = label.copy()
        for start in range(0, len(sets), TILE):
            mine = slice(start, start + TILE)
            low[mine] = np.minimum(low[mine], np.where(linked[mine], label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == label).all():
            break
        label = low
    return sorted({(int(i), int(x)) for i, x in zip(ids, label) if i != x})


def _held(ids: list[int], sets: list[np.ndarray], doc: int, own: np.ndarray) -> bool:
    for i in range(len(ids) - 1, -1, -1):
        if ids[i] != doc:
            return False
        if np.array_equal(sets[i], own):
            return True
    return False


def _compared(percent: int):
    """Sorted rows of blocks: the components within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            pairs = _joined(np.array(ids, np.int64), sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "i", "j")))
            lists = batch.column("shingles")
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
            for k, (key, doc) in enumerate(zip(keys, batch.column("doc_id").to_pylist())):
                if key != now:
                    if len(ids) > 1:
                        yield flush()
                    now, ids, sets = key, [], []
                own = values[offsets[k] : offsets[k + 1]]
                # Texts that share a doc_id come one after another; equal ones are one.
                if not _held(ids, sets, doc, own):
                    ids.append(doc)
                    sets.append(own.copy())
        if len(ids) > 1:
            yield flush()

    return run


def _rest(shared: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What the comparison with hubs left open: pairs of members of a hub's buckets of
    which at least one is apart from the hub. Members are dealt into blocks; a block of
    members apart meets every other block once, members joined with the hub meet no other
    such member."""
    labels = joined.select(F.col("node").alias("doc_id"), "component")
    hubs = joined.select(F.col("node").alias("hub"), F.col("component").alias("_h"))
    placed = (
        shared.join(labels, "doc_id", "left")
        .join(hubs, "hub", "left")
        .select("hub", "doc_id", "n", (F.coalesce("component", "doc_id") != F.coalesce("_h", "hub")).alias("apart"))
    )
    share = F.greatest(F.col("n") / BLOCK_SHINGLES, F.lit(1 / BLOCK_DOCS))
    size = lambda apart: F.ceil(F.sum(F.when(F.col("apart") == apart, share).otherwise(0.0))).cast("int")
    groups = (
        placed.groupBy("hub")
        .agg(size(True).alias("open_blocks"), F.greatest(size(False), F.lit(1)).alias("main_blocks"), F.count(F.lit(1)).alias("members"))
        .where("open_blocks > 0 and members > 2")
    )
    dealt = (
        placed.withColumn("_k", F.struct("hub"))
        .join(groups.select(F.struct("hub").alias("_k"), "open_blocks", "main_blocks"), "_k")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("apart"), F.col("open_blocks")).otherwise(F.col("main_blocks"))).cast("int"))
    )
    blocks = F.when(
        F.col("apart"),
        F.expr(
            "concat(transform(sequence(0, open_blocks - 1), o -> struct(0 as kind, least(own, o) as i, greatest(own, o) as j)),"
            " transform(sequence(0, main_blocks - 1), o -> struct(1 as kind, own as i, o as j)))"
        ),
    ).otherwise(F.expr("transform(sequence(0, open_blocks - 1), o -> struct(1 as kind, o as i, own as j))"))
    order = ["hub", "kind", "i", "j"]
    rows = (
        dealt.select("hub", "doc_id", F.explode(blocks).alias("w"))
        .select("hub", "doc_id", "w.kind", "w.i", "w.j")
        .join(sets, "doc_id")
        .select(*order, "doc_id", "shingles")
    )
    many = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arranged = rows.repartition(many, *order).sortWithinPartitions(*order, "doc_id")
    return materialize(arranged.mapInArrow(tidy(_compared(percent)), "a long, b long").distinct(), "rest")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept.

    Null and blank texts have an empty set and link with nothing. Rows with a null
    doc_id link with nothing; their component_id is null and they are kept. Rows that
    share a doc_id are one document with the links of each of its texts. Other columns
    are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialize(texts.mapInArrow(tidy(_signed), _SIGNED), "signed")
    first = (
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"))
    )
    copies = materialize(
        signed.where("digest is not null and doc_id is not null")
        .select("doc_id", F.struct("digest").alias("_k"))
        .join(first.select(F.struct("digest").alias("_k"), "rep"), "_k")
        .select("doc_id", "rep")
        .where("doc_id != rep")
        .distinct(),
        "copies",
    )
    rows = (
        signed.join(first.select("rep", "digest"), "digest")
        .where("doc_id = rep")
        .select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("key"))
    )
    hubs = (
        rows.groupBy("key")
        .agg(F.min("doc_id").alias("hub"), F.min_by("n", "doc_id").alias("m"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
    )
    # Every document of a bucket with the bucket's hub, the hub included, once.
    shared = materialize(
        rows.withColumn("_k", F.struct("key"))
        .join(hubs.select(F.struct("key").alias("_k"), "hub", "m"), "_k")
        .select("doc_id", "n", "hub", "m")
        .distinct(),
        "shared",
    )
    sets = _sets(texts, shared.select("doc_id"))
    stars = shared.where("doc_id != hub").where(_near("n", "m", percent)).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    links = _confirmed(stars.distinct(), sets, percent)
    joined = materialize(components(links.unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))), "joined")
    rest = _rest(shared.select("hub", "doc_id", "n").distinct(), joined, sets, percent)
    members = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    members = materialize(members, "members")
    result = (
        signed.select("doc_id", "n_shingles")
        .join(members, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
    discard(shared, sets, links, rest, copies, joined)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with the smallest
    doc_id. Of rows that share doc_id and text one stays, and all texts of a doc_id do; rows
    without a doc_id all stay. Further columns are carried along, whatever their names."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    digest = F.sha2(F.col("text").cast("string"), 256)
    kept = docs.select(F.col("doc_id"), digest.alias("digest"), own.alias("own"), F.struct(*docs.columns).alias("row"))
    return kept.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "digest", "own"]).select("row.*")
