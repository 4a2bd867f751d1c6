"""Cost-balanced packing of token sequences (operator 8).

A document's cost is estimated as ``tokens + tokens ** 2 / QUADRATIC``: a linear part and
attention. Whole sequences are cut from a long document where it is tokenized, without a
shuffle; they are full. What is left of each document goes to one of many shards. There,
in descending length, each document goes to the sequence of lowest cost that has room for
it; one that fits nowhere is cut and fills the sequences with most room. A shard has as
many sequences as its tokens fill; the tokens beyond full sequences go to sequences whose
lengths are powers of two, which need no padding.

Where documents have a place in an order, shards are ranges of it and sequences are
numbered by it: a whole sequence by the place of its document, the others of a shard, in
the order of their tokens' mean place, spread over the places of the shard.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listingflow.llm.words import remembered, slices, texts_of, tidy
from listingflow.scratch import materialize

CAPACITY = 1024
END = 0
#: Tokens at which attention costs as much as the linear part.
QUADRATIC = 4096
#: Tokens of one shard: some 2,000 sequences, a few MB.
SHARD_TOKENS = 1 << 21
#: Distinct chunks a worker process remembers, some 100 MB at most.
REMEMBERED = 1 << 19
#: Sequences numbered for one place: half for the whole ones of its document.
PLACE_BITS = 24
#: Cells of places whose tokens are added up together to find shards.
CELLS = 256

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENIZED = _PIECES + ", row long, rest binary"

class Chunks:
    """Token ids of texts, with each distinct chunk tokenized once.

    Byte-level BPE never merges over the start of a space that precedes another
    character, so a text whose spaces are all of that kind can be cut before each of
    them. Other texts are tokenized whole.
    """

    def __init__(self, tokenizer_path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leading = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.leading[i] = token.startswith("Ġ")  # how the vocabulary spells a leading space
        self._forget()

    def _forget(self) -> None:
        #: Place of each known chunk; its ids are ``ids[starts[place]:starts[place + 1]]``.
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def places(self, chunks: list[str]) -> np.ndarray:
        """The place of each chunk; new ones are tokenized, some thousand joined to one text."""
        if len(self.known) > REMEMBERED:
            self._forget()
        out = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        fresh = np.flatnonzero(out < 0)
        new = [chunks[k] for k in fresh]
        ids, starts, end = [self.ids], [self.starts], self.starts[-1]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            found = self.whole([" " + " ".join(some)])[0]
            cuts = np.flatnonzero(self.leading[found])
            if len(cuts) != len(some):  # a chunk that holds such a token itself
                parts = self.whole([" " + c for c in some])
                found = np.concatenate(parts)
                cuts = np.cumsum([0, *map(len, parts)])[:-1]
            ids.append(found)
            starts.append(end + np.append(cuts[1:], len(found)))
            end += len(found)
        out[fresh] = len(self.known) + np.arange(len(new))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)
        return out

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, r" ([\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]|$)").to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        index = np.asarray(coded.indices)
        inner = np.ones(len(index), bool)
        inner[offsets[:-1]] = False
        inner[np.repeat(whole, np.diff(offsets))] = False
        asked = np.zeros(len(coded.dictionary), bool)
        asked[index[inner]] = True
        used = np.flatnonzero(asked)
        place = self.places(coded.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        heads = self.whole(
            [texts[i].as_py() if whole[i] else coded.dictionary[int(index[k])].as_py() for i, k in enumerate(offsets[:-1])]
        )
        # Where the ids of all pieces lie and how many they are, in order: the first of a
        # text is its head, whose ids follow the known ones.
        first, count = np.zeros((2, len(coded.dictionary)), np.int64)
        first[used], count[used] = self.starts[place], self.starts[place + 1] - self.starts[place]
        begins, sizes = first[index], count[index] * inner
        head_sizes = np.fromiter(map(len, heads), np.int64, len(heads))
        begins[offsets[:-1]] = len(self.ids) + np.cumsum(head_sizes) - head_sizes
        sizes[offsets[:-1]] = head_sizes
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = np.concatenate([self.ids, *heads])[np.repeat(begins - ends + sizes, sizes) + np.arange(total)]
        bounds = np.append(0, ends)[offsets]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield out[a:b]


@remembered
@lru_cache(maxsize=1)
def chunks_of(tokenizer_path: str) -> Chunks:
    """One tokenizer for a worker process, with the chunks that its tasks met last."""
    return Chunks(tokenizer_path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenize(tokenizer_path: str, placed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Numbers that no other task uses; they are read back from the written table.
        row = TaskContext.get().partitionId() << 36
        sequence = row
        chunks = chunks_of(tokenizer_path)
        for batch in slices(batches, "text", 4 << 20):
            out: list[tuple] = []
            at = batch.column("place").to_pylist() if placed else None
            for i, (doc_id, ids) in enumerate(zip(batch.column("doc_id").to_pylist(), chunks.encode(texts_of(batch, "text")))):
                if at is not None:
                    row, sequence = at[i], at[i] << PLACE_BITS
                ids = np.append(ids, np.uint32(END))
                full = len(ids) // CAPACITY * CAPACITY
                for start in range(0, full, CAPACITY):
                    out.append((doc_id, start, CAPACITY, _crc(ids[start : start + CAPACITY]), len(ids), sequence, 0, row, None))
                    sequence += 1
                if full < len(ids):
                    rest = ids[full:]
                    kind = "<u2" if rest.max() < 1 << 16 else "<u4"
                    out.append((doc_id, full, len(rest), None, len(ids), None, None, row, rest.astype(kind).tobytes()))
                row += 1
            names = [f.split()[0] for f in _TOKENIZED.split(", ")]
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def cost(tokens: int) -> float:
    return tokens + tokens * tokens / QUADRATIC


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard.

    ``lengths`` are in descending order and below ``capacity``.
    """
    total = sum(lengths)
    rooms = [capacity] * (total // capacity)
    beyond = total - sum(rooms)
    # The bits of the remainder: each a sequence that a power of two fills.
    rooms += [1 << b for b in reversed(range(beyond.bit_length())) if beyond >> b & 1]
    size = list(rooms)
    by_cost = [(0.0, s) for s in range(len(rooms))]
    heapq.heapify(by_cost)
    by_room = [(-r, s) for s, r in enumerate(rooms)]
    heapq.heapify(by_room)
    costs = [0.0] * len(rooms)
    pieces = []

    def put(doc: int, start: int, length: int, s: int) -> None:
        pieces.append((doc, start, length, s, size[s] - rooms[s]))
        rooms[s] -= length
        costs[s] += cost(length)
        if rooms[s]:
            heapq.heappush(by_cost, (costs[s], s))
            heapq.heappush(by_room, (-rooms[s], s))

    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            while by_room and -by_room[0][0] != rooms[by_room[0][1]]:
                heapq.heappop(by_room)
            wanted = length - start
            if -by_room[0][0] < wanted:
                room, s = heapq.heappop(by_room)
                put(doc, start, -room, s)
                start -= room
                continue
            passed = []
            while True:
                c, s = heapq.heappop(by_cost)
                if c != costs[s] or not rooms[s]:
                    continue
                if rooms[s] >= wanted:
                    break
                passed.append((c, s))
            for entry in passed:
                heapq.heappush(by_cost, entry)
            put(doc, start, wanted, s)
            start = length
    return pieces


def _packed(placed: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        ids = []
        for rest, n in zip(group["rest"], group["length"]):
            ids.append(np.frombuffer(rest, "<u2" if len(rest) == 2 * n else "<u4"))
        pieces = assign(group["length"].tolist())
        numbers = _placed(pieces, group["row"].to_numpy()) if placed else (1 << 62) + (int(group["shard"].iloc[0]) << 24) + np.arange(len(pieces))
        out = []
        for doc, start, length, sequence, offset in pieces:
            out.append(
                (
                    group["doc_id"].iat[doc], group["start"].iat[doc] + start, length, _crc(ids[doc][start : start + length]),
                    group["doc_tokens"].iat[doc], numbers[sequence], offset,
                )
            )
        result = pd.DataFrame(out, columns=[f.split()[0] for f in _PIECES.split(", ")])
        return result.astype({c: "int64" for c in result.columns if c != "doc_id"})

    return run


def _placed(pieces: list[tuple[int, int, int, int, int]], places: np.ndarray) -> np.ndarray:
    """The number of each sequence of a shard whose documents have these ``places``."""
    doc, _, length, sequence, _ = (np.array(c) for c in zip(*pieces))
    first = places.min()
    mean = np.bincount(sequence, (places[doc] - first) * length) / np.bincount(sequence, length)
    rank = np.empty(len(mean), np.int64)
    rank[np.argsort(mean, kind="stable")] = np.arange(len(mean))
    spread = np.sort(places)[(2 * rank + 1) * len(places) // (2 * len(mean))]
    return (spread.astype(np.int64) << PLACE_BITS) + (1 << PLACE_BITS - 1) + rank


def _ranges(rests: DataFrame) -> DataFrame:
    """``rests`` with ``shard``: ranges of places with ``SHARD_TOKENS`` to twice as many
    tokens, where what begins every ``CELLS`` cells has that many. A cell of places has no
    more than ``SHARD_TOKENS``, as every rest is shorter than a sequence."""
    cell = F.floor(F.col("row") / max(1, SHARD_TOKENS // CAPACITY)).alias("cell")
    sums = rests.groupBy(cell).agg(F.sum("length").alias("tokens")).withColumn("part", F.floor(F.col("cell") / CELLS))
    before = F.sum("tokens").over(W.partitionBy("part").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    shard = F.col("part") * CELLS + F.floor(F.coalesce(before, F.lit(0)) / SHARD_TOKENS)
    return rests.withColumn("cell", cell).join(sums.select("cell", shard.alias("shard")), "cell").drop("cell")


def pack(docs: DataFrame, tokenizer_path: str, place: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text, ...)``: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    ``place`` names a column of distinct whole numbers, from 0 to below 2 ** 39, that orders
    the rows: ascending sequence_ids then follow it. Without it sequences have no order.

    A null or empty text is the end token alone. Rows that repeat a doc_id are packed as
    documents of their own under that id; a null doc_id stays null. An empty table gives
    no rows; other columns are not looked at.
    """
    placed = place is not None
    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), *([F.col(place).cast("long").alias("place")] if placed else [])
    )
    tokenized = materialize(texts.mapInArrow(tidy(_tokenize(tokenizer_path, placed), chunks_of.__name__), _TOKENIZED), "tokenized")
    full = tokenized.where("rest is null").select(*[f.split()[0] for f in _PIECES.split(", ")])
    rests = tokenized.where("rest is not null").select("doc_id", "start", "length", "doc_tokens", "row", "rest")
    if placed:
        sharded = _ranges(rests)
    else:
        tokens = rests.agg(F.sum("length")).first()[0] or 0
        shards = max(1, round(tokens / SHARD_TOKENS))
        sharded = rests.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return full.unionByName(sharded.groupBy("shard").applyInPandas(_packed(placed), _PIECES))
