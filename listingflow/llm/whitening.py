"""Whitening of embeddings with covariances by polarisation (operator 11).

Entries become whole numbers, and everything that is added up over rows is exact. The fit
list holds each distinct vector once. With ``n`` its size, ``S`` a dimension's sum and
``y = n * x - S`` a centred value, tasks add up the squares of ``y_i`` for every dimension
and of ``y_i + y_j`` for every pair. Half the difference between a pair's sum and those of
its two dimensions is the sum of ``y_i * y_j``; so all covariances follow from sums of
squares. What reaches the driver is a number for each dimension and each pair, which
doesn't grow with the rows; there the matrix is decomposed.

Vectors of different lengths are fitted apart, each length as a table of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.scratch import discard, materialize

#: Steps between whole numbers; components returned.
SCALE, COMPONENTS = 256, 4
#: Rows whose pairs are added up together; it bounds a task's memory.
ROWS = 2048
#: Sums travel as three decimals to this base, so that no total overflows.
BASE = 10**30
_BITS = 21

_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def quantised(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` for each length of the vectors without null or non-finite entries, where
    ``x`` holds ``floor(256 * c)``. Entries too large for 64 bits count as not finite."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) < 2.0**62)  # also nulls, which read as not a number
    whole = column.is_valid().to_numpy(zero_copy_only=False).astype(bool) & (np.bincount(row[bad], minlength=len(lengths)) == 0)
    out = []
    for d in np.unique(lengths[whole & (lengths > 0)]):
        rows = np.flatnonzero(whole & (lengths == d))
        out.append((rows, np.floor(values[starts[rows][:, None] + np.arange(d)]).astype(np.int64)))
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as the bytes of the narrowest type that holds it: equal ones have equal bytes."""
    for batch in batches:
        for _, x in quantised(batch.column("embedding")):
            high = np.abs(x).max(axis=1)
            kinds = np.select([high < 1 << 15, high < 1 << 31], [2, 4], 8)
            for kind in np.unique(kinds):
                some = x[kinds == kind].astype(f"<i{kind}")
                data = pa.array([r.tobytes() for r in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), x.shape[1], np.int32)), data], names=["dim", "x"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        dims, sizes = np.asarray(batch.column("dim")), np.asarray(pc.binary_length(batch.column("x")))
        for d, size in np.unique(np.stack([dims, sizes]), axis=1).T.tolist():
            rows = batch.column("x").filter(pa.array((dims == d) & (sizes == size))).to_pylist()
            for start in range(0, len(rows), ROWS):
                some = rows[start : start + ROWS]
                yield np.frombuffer(b"".join(some), f"<i{size // d}").reshape(len(some), d).astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, in Python's whole numbers where 64 bits could overflow, also doubled."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(z: np.ndarray) -> np.ndarray:
    """The exact sum of the squares of each column, as Python's whole numbers. 64-bit values
    are cut into three limbs, whose products add up in 64 bits over ``2 ** 16`` rows."""
    if z.dtype == object:
        return (z * z).sum(axis=0)
    total = np.zeros(z.shape[1], object)
    for start in range(0, len(z), 1 << 16):
        part = z[start : start + (1 << 16)]
        low = (1 << _BITS) - 1
        a, b, c = part >> 2 * _BITS, part >> _BITS & low, part & low
        for shift, pairs in enumerate((((c, c),), ((b, c), (b, c)), ((a, c), (a, c), (b, b)), ((a, b), (a, b)), ((a, a),))):
            sums = sum(np.einsum("ij,ij->j", p, q) for p, q in pairs)
            total = total + (sums.astype(object) << shift * _BITS)
    return total


def _exact(totals: dict[tuple[int, int, int], int]) -> Iterator[pa.RecordBatch]:
    """Rows ``(dim, i, j)`` with their totals as three decimals."""
    keys = list(totals)
    for start in range(0, len(keys), 1 << 16):
        some = keys[start : start + (1 << 16)]
        parts: list[list[Decimal]] = [[], [], []]
        for k in some:
            value = totals[k]
            for p in parts[:2]:
                value, rest = divmod(value, BASE)
                p.append(Decimal(rest))
            parts[2].append(Decimal(value))
        columns = [pa.array(c, pa.int32()) for c in zip(*some)] + [pa.array(p, pa.decimal128(38, 0)) for p in parts]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "j", "p0", "p1", "p2"])


def _totals(fit: DataFrame, run) -> dict[tuple[int, int, int], int]:
    """The totals of all tasks: one row for each dimension and pair."""
    found = (
        fit.mapInArrow(run, "dim int, i int, j int, p0 decimal(38,0), p1 decimal(38,0), p2 decimal(38,0)")
        .groupBy("dim", "i", "j")
        .agg(*[F.sum(p).alias(p) for p in ("p0", "p1", "p2")])
    )
    return {(r.dim, r.i, r.j): int(r.p0) + BASE * (int(r.p1) + BASE * int(r.p2)) for r in found.toLocalIterator()}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every length the number of vectors, as ``(-1, -1)``, and each dimension's sum."""
    totals: dict[tuple[int, int, int], int] = {}
    for x in _unpacked(batches):
        d = x.shape[1]
        # Upper and lower halves each add up in 64 bits.
        sums = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        totals[d, -1, -1] = totals.get((d, -1, -1), 0) + len(x)
        for i, s in enumerate(sums):
            totals[d, i, i] = totals.get((d, i, i), 0) + s
    yield from _exact(totals)


def _squares(sizes: dict[int, tuple[int, list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for x in _unpacked(batches):
            d = x.shape[1]
            y = centred(x, *sizes[d])
            rows = totals.setdefault(d, [np.zeros(d - i, object) for i in range(d)])
            for i in range(d):
                z = y[:, i:] + y[:, i : i + 1]
                z[:, 0] = y[:, i]  # the dimension by itself
                rows[i] = rows[i] + square_sums(z)
        yield from _exact({(d, i, i + k): int(t) for d, rows in totals.items() for i, r in enumerate(rows) for k, t in enumerate(r)})

    return run


@dataclass
class Space:
    """What vectors of one length need to be whitened."""

    n: int
    sums: list[int]
    #: Unit eigenvectors as columns, their eigenvalues, and these as shares of the trace.
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows of centred values in the space of the components; a component without
        variance gives NaN."""
        roots = np.where(self.values > 0, np.sqrt(np.abs(self.values)), np.nan)
        return (y / self.n).astype(float) @ self.axes / roots


def space(d: int, n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int) -> Space:
    """Covariances from sums of squares, and the leading eigenvectors. An eigenvalue within
    rounding of zero is zero."""
    cross = {(i, j): squares[i, j] - squares[i, i] - squares[j, j] for i, j in squares if i != j}
    cov = np.empty((d, d))
    for (i, j), q in squares.items():
        # Whole numbers are divided exactly rounded; half the difference is the cross sum.
        cov[i, j] = cov[j, i] = q / n**3 if i == j else cross[i, j] / (2 * n**3)
    values, axes = np.linalg.eigh(cov)
    trace = sum(squares[i, i] for i in range(d)) / n**3
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    values = np.where(values > d * np.finfo(float).eps * trace, values, 0.0)
    return Space(n, sums, axes, values, values / trace if trace else np.zeros(len(values)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Space], float | None]:
    """The space of each length, and the largest entry by which the covariance of whitened
    components differs from the identity (None without a component of any variance)."""
    distinct = materialize(vectors.mapInArrow(_packed, "dim int, x binary").distinct(), "fit")
    totals = _totals(distinct, _sums)
    sizes = {d: (n, [totals[d, i, i] for i in range(d)]) for (d, i, _), n in totals.items() if i < 0}
    squares: dict[int, dict[tuple[int, int], int]] = {d: {} for d in sizes}
    for (d, i, j), q in _totals(distinct, _squares(sizes)).items():
        squares[d][i, j] = q
    spaces = {d: space(d, n, sums, squares[d], components) for d, (n, sums) in sizes.items()}

    names = [f"w{k}" for k in range(components)]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _unpacked(batches):
            d = x.shape[1]
            w = np.full((len(x), components), np.nan)
            w[:, : min(d, components)] = spaces[d].whiten(centred(x, *sizes[d]))
            columns = [pa.array(w[:, k], from_pandas=True) for k in range(components)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), *columns], names=["dim", *names])

    pairs = [(a, b) for b in range(components) for a in range(b + 1)]
    found = (
        distinct.mapInArrow(whitened, "dim int, " + ", ".join(f"{w} double" for w in names))
        .groupBy("dim")
        .agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs])
        .collect()
    )
    discard(distinct)
    apart = [abs(r[f"c{a}_{b}"] - (a == b)) for r in found for a, b in pairs if r[f"c{a}_{b}"] is not None]
    return spaces, max(apart, default=None)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every row of ``vectors(vec_id, embedding, ...)`` that can be fitted, once for each of
    the leading components: vec_id, component from 1, n, deviation (sum of the squares of
    ``n * x - S``, exact), whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null or non-finite entry, or one of 2**54
    and more, are left out. Repeated rows and null vec_ids are rows like others; equal
    vectors are fitted once. Eigenvectors of equal eigenvalues come in any rotation.
    A component without variance has whitened null and explained 0; so has every one where
    all vectors are equal. A deviation of more than 38 digits is null. An empty table gives
    no rows; other columns are not looked at.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    spaces, error = fit(rows.select("embedding"), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chosen, x in quantised(batch.column("embedding")):
                at = spaces[x.shape[1]]
                k = len(at.values)
                y = centred(x, at.n, at.sums)
                far = [Decimal(int(q)) if q < 10**38 else None for q in square_sums(y.T)]
                size = len(chosen)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(chosen, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, at.n)),
                        pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(size), k))),
                        pa.array(at.whiten(y).ravel(), from_pandas=True),
                        pa.array(np.tile(at.shares, size)),
                        pa.array([error] * (size * k), pa.float64()),
                    ],
                    names=[f.split()[0] for f in _RESULT.split(", ")],
                )

    return rows.mapInArrow(run, _RESULT)
