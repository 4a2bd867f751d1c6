"""A log-structured ledger of the keys that a growing store has.

Every batch adds a run of key digests, parted into buckets by the first bits of the digest;
a run has as many buckets as keep each below a number of keys. Whenever ``FAN_IN`` runs of a
level are there, they are merged into one of the next level, so a ledger of any age has a
few runs for each level and the number of levels is the logarithm of that of batches. A look-up
reads, of each run, only the buckets that its own keys fall in.

Which runs there are follows from the number of the batch alone. A batch that is repeated
finds the runs it found before, none of which has its own keys, and writes the same run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.functions.text import text_or_empty

#: Runs of a level that are merged into one of the next.
FAN_IN = 8
#: Keys of a bucket, some 40 MB; most different buckets that a look-up lists by number.
KEYS_PER_BUCKET, LISTED = 1 << 20, 4096
#: Bits of a digest that buckets are made of.
_BITS = 32

_SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("_bucket", T.LongType())])


def key_digest(kind: str, *parts: Column | str) -> Column:
    """One 32-byte key of several texts; lengths keep apart what only looks alike when joined."""
    texts = [text_or_empty(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    sized = [c for t in texts for c in (F.length(t).cast("string"), F.lit(":"), t)]
    return F.unhex(F.sha2(F.concat(F.lit(kind), F.lit(" "), *sized), 256))


def _prefix(bits: int) -> Column:
    first = F.conv(F.hex(F.substring("key", 1, _BITS // 8)), 16, 10).cast("long")
    return F.shiftright(first, _BITS - bits)


def cover(batch_id: int, fan_in: int = FAN_IN) -> list[tuple[int, int]]:
    """The runs ``(level, first batch)`` that hold the batches before ``batch_id``, oldest
    first: as many of each level as the number has in this place to the base of the fan-in."""
    runs, level, unit, rest = [], 0, 1, batch_id
    while unit <= batch_id:
        digit = batch_id // unit % fan_in
        rest -= digit * unit
        runs = [(level, rest + i * unit) for i in range(digit)] + runs
        level, unit = level + 1, unit * fan_in
    return runs


def merges(batch_id: int, fan_in: int = FAN_IN) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """The merges due before ``batch_id``, lowest level first: the new run and its parts."""
    out, level, unit = [], 0, 1
    while batch_id > 0 and batch_id % (unit * fan_in) == 0:
        start = batch_id - unit * fan_in
        out.append(((level + 1, start), [(level, start + i * unit) for i in range(fan_in)]))
        level, unit = level + 1, unit * fan_in
    return out


class Ledger:
    """The ledger in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN, keys_per_bucket: int = KEYS_PER_BUCKET) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fan_in, self.keys_per_bucket = fan_in, keys_per_bucket

    def _folder(self, run: tuple[int, int]) -> str:
        return f"{self.path}/level={run[0]}/start={run[1]}"

    def _fs(self, folder: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _bits(self, run: tuple[int, int]) -> int | None:
        """The bucket bits of a finished run, which are part of its path; None without one."""
        fs, folder = self._fs(self._folder(run))
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            name = status.getPath().getName()
            done = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("bits=") and fs.exists(done):
                return int(name.removeprefix("bits="))
        return None

    def _drop(self, run: tuple[int, int]) -> None:
        fs, folder = self._fs(self._folder(run))
        fs.delete(folder, True)

    def _write(self, keys: DataFrame, run: tuple[int, int], count: int) -> None:
        self._drop(run)
        bits = min(_BITS, max(0, -(-count // self.keys_per_bucket) - 1).bit_length())
        # One file for each bucket, keys in order.
        parted = keys.select("key", _prefix(bits).alias("_bucket")).repartition("_bucket").sortWithinPartitions("_bucket", "key")
        parted.write.partitionBy("_bucket").parquet(f"{self._folder(run)}/bits={bits}")

    def _read(self, run: tuple[int, int], bits: int) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self._folder(run)}/bits={bits}")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Note the distinct ``keys(key)`` of a batch. ``keys`` is read twice."""
        keys = keys.select("key").distinct()
        self._write(keys, (0, batch_id), keys.count())

    def _merge(self, batch_id: int) -> None:
        for run, parts in merges(batch_id, self.fan_in):
            if self._bits(run) is None:
                found = [(p, bits) for p in parts if (bits := self._bits(p)) is not None]
                if found:
                    keys = reduce(DataFrame.unionByName, [self._read(p, bits).select("key") for p, bits in found]).distinct()
                    self._write(keys, run, keys.count())
            # Batches before this one are finished: nothing reads the parts again.
            for p in parts:
                self._drop(p)

    def lookups(self, keys: DataFrame, batch_id: int) -> list[tuple[tuple[int, int], int, set[int] | None]]:
        """Each run before ``batch_id`` with its bucket bits and the buckets that ``keys``
        fall in, or None for all of them."""
        self._merge(batch_id)
        runs = [(run, bits) for run in cover(batch_id, self.fan_in) if (bits := self._bits(run)) is not None]
        most = max((bits for _, bits in runs), default=0)
        # At most a bounded number of buckets is listed; a batch with more reads them all.
        wanted = [r["b"] for r in keys.select(_prefix(most).alias("b")).distinct().limit(LISTED + 1).collect()] if most else []
        listed = most > 0 and len(wanted) <= LISTED
        return [(run, bits, {b >> most - bits for b in wanted} if listed and bits else None) for run, bits in runs]

    def known(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Those of ``keys(key)`` that a batch before ``batch_id`` has added, as distinct rows."""
        frames = []
        for run, bits, buckets in self.lookups(keys, batch_id):
            frame = self._read(run, bits)
            frames.append((frame if buckets is None else frame.where(F.col("_bucket").isin(*buckets))).select("key"))
        if not frames:
            return keys.select("key").limit(0)
        mine = keys.select(F.col("key").alias("_want")).distinct()
        return reduce(DataFrame.unionByName, frames).join(mine, F.col("key") == F.col("_want"), "left_semi").distinct()


def without_known(rows: DataFrame, keys: Sequence[Column], ledger: Ledger, batch_id: int, ord_col: str = "ord") -> DataFrame:
    """Rows none of whose ``keys`` an earlier batch has added; a null key matches nothing."""
    keyed = rows.select(ord_col, F.explode(F.array_compact(F.array(*keys))).alias("key"))
    known = ledger.known(keyed.select("key"), batch_id).select(F.struct("key").alias("_k"))
    old = keyed.select(ord_col, F.struct("key").alias("_k")).join(known, "_k", "left_semi").select(ord_col).distinct()
    return rows.join(old, ord_col, "left_anti")
