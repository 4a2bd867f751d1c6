"""Words of whole texts as arrays of hashes, one Arrow batch at a time.

Words are maximal runs of anything but ASCII white space, with A-Z in lower case.
Each distinct word of a batch is hashed once; the rest is array arithmetic.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd 64-bit multipliers of the hash mixing steps.
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: What this worker process remembers from task to task, by the name of what made it.
_remembered: dict[str, Callable[[], None]] = {}


def remembered(cached: Callable) -> Callable:
    """Mark an ``lru_cache`` of much memory: a ``tidy`` task keeps only the one that it names."""
    _remembered[cached.__name__] = cached.cache_clear
    return cached


def _let_go(keeps: str) -> None:
    """Forget what other tasks of this worker process remember."""
    for name, clear in _remembered.items():
        if name != keeps:
            clear()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` that gives memory back to the machine when it ends: worker processes are used
    again, and what their allocators keep adds up over the stages of a job. When it begins,
    what other stages remembered goes, except what ``remembered`` has under ``keeps``."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keeps)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have ``most`` bytes, or are one long text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < len(lengths):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with nulls as empty texts and offsets that hold any size. It is a copy
    that begins at offset zero: some text kernels misread slices of larger arrays."""
    values = batch.column(column).cast(pa.large_string())
    return pc.fill_null(values.take(pa.array(np.arange(len(values)))), "")


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, an index into the distinct words, and these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return kept[offsets], np.asarray(coded.indices), coded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words and the 64-bit hash of every word."""
    offsets, index, distinct = split_words(texts)
    if len(distinct) == 0:
        return offsets, np.empty(0, np.uint64)
    return offsets, hash_strings(distinct)[index]


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring words (also across texts: mask these)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * STEP + hashes[i : i + n]
    return mix(total + np.uint64(width))
