"""Near-duplicate embeddings by sorted projection passes (operator 1).

1. Equal vectors are one vector with a count.
2. Vectors are sorted by the bits of random projections. Among neighbours, those within
   half the link angle of a leader form a ball: all its members are linked, by the
   triangle inequality, and need no comparison.
3. Each of ``PASSES`` passes sorts the leaders by fresh concatenated projection bits and
   compares each with the next ``WINDOW``. Angle and radii tell for most pairs of balls
   that all or none of their members are linked; the members of the others are compared.
4. Links of all passes are united. In a component with more balls than a window holds,
   all its balls are compared, in blocks, so a dense component has no window to miss links.

Work is linear in the rows but for step 4, which compares within a component what the
bounds leave open; equal vectors and balls make that few. A link of cosine c is missed
where no pass brings it into a window: with n leaders a pass separates the two with
probability about 1 - (1 - acos(c) / pi) ** log2(n / WINDOW), so for a million leaders all
24 passes miss a pair at 0.95 with probability 0.0002, at 0.98 less than 1e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.graph import components
from listingflow.scratch import discard, materialize

THRESHOLD = 0.95
PASSES, WINDOW, BITS = 24, 128, 62
#: Rows among which balls are formed, and rows of a block of step 4.
BLOCK = 1024
SEED = 5
#: Bounds from angles are trusted only this far from the limit.
MARGIN = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _stack(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _codes(units: np.ndarray, turn: int) -> np.ndarray:
    rng = np.random.default_rng((SEED, turn, units.shape[1]))
    planes = rng.standard_normal((units.shape[1], BITS))
    return ((units @ planes > 0) << np.arange(BITS - 1, -1, -1, dtype=np.int64)).sum(axis=1)


def _coded(turns: range):
    """Rows of ``vec_id, embedding, weight, radius`` once for each pass, with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pa.compute.list_value_length(batch.column("embedding")))
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                units = unit(_stack(part.column("embedding")))
                for turn in turns:
                    fixed = [pa.array(np.full(len(part), x, np.int32)) for x in (turn, size)]
                    yield pa.RecordBatch.from_arrays(
                        [*fixed, pa.array(_codes(units, turn)), *part.columns], names=["turn", "size", "code", *part.schema.names]
                    )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows of one pass and vector size at a time, in pieces of at least ``BLOCK``
    rows; tells whether a piece goes on in the next one."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if len(held) >= 8 * BLOCK:
            kinds = np.stack([np.asarray(held.column(c)) for c in ("turn", "size")], axis=1)
            cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1), len(held)]
            for a, b in zip(cuts[:-2], cuts[1:-1]):
                yield held.slice(a, b - a), False
            held = held.slice(cuts[-2])
            if len(held) >= 8 * BLOCK:
                yield held, True
                held = None
    if held is not None and len(held):
        kinds = np.stack([np.asarray(held.column(c)) for c in ("turn", "size")], axis=1)
        cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1), len(held)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield held.slice(a, b - a), False


def _balls(half: float):
    """Leaders of one sorted pass: ``vec_id, leader, angle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _groups(batches):
            for start in range(0, len(table), BLOCK):
                part = table.slice(start, BLOCK)
                ids = np.asarray(part.column("vec_id"))
                order = np.argsort(ids, kind="stable")
                ids, units = ids[order], unit(_stack(part.column("embedding")))[order]
                angles = np.arccos(np.clip(units @ units.T, -1, 1))
                leader = np.full(len(ids), -1)
                for i in range(len(ids)):
                    if leader[i] < 0:
                        mine = (leader < 0) & (angles[i] <= half - MARGIN)
                        leader[mine] = i
                        leader[i] = i
                away = angles[np.arange(len(ids)), leader]
                away[leader == np.arange(len(ids))] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(ids[leader]), pa.array(away)], names=["vec_id", "leader", "angle"]
                )

    return run


def _compare(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    """0: no members linked, 1: all, 2: the members decide."""
    cosines = a @ b.T
    radii = ra[:, None] + rb[None, :]
    limit = math.acos(threshold)
    angles = np.arccos(np.clip(cosines, -1, 1))
    kind = np.where(angles + radii <= limit - MARGIN, 1, np.where(angles - radii > limit + MARGIN, 0, 2))
    return np.where(radii == 0, (cosines >= threshold).astype(int), kind)


_PAIRS = "a long, b long, kind int"
_WINDOWED = _PAIRS + ", place int, side int, nth int, seam int, size int, vec_id long, embedding array<double>, weight long, radius double"


def _pair_rows(ids: np.ndarray, units: np.ndarray, radii: np.ndarray, reach: int, threshold: float, fresh: int = 0):
    """Linked or open pairs of rows at most ``reach`` apart; pairs among the first
    ``fresh`` rows were compared before."""
    out = []
    for start in range(0, len(ids), BLOCK):
        stop = min(start + BLOCK, len(ids))
        end = min(stop + reach, len(ids))
        kind = _compare(units[start:stop], units[start:end], radii[start:stop], radii[start:end], threshold)
        gap = np.arange(start, end)[None, :] - np.arange(start, stop)[:, None]
        kind[(gap <= 0) | (gap > reach) | (np.arange(start, end)[None, :] < fresh)] = 0
        i, j = np.nonzero(kind)
        x, y = ids[start + i], ids[start + j]
        out.append((np.minimum(x, y), np.maximum(x, y), kind[i, j]))
    return [np.concatenate(c) if out else np.empty(0) for c in zip(*out)]


def _windows(threshold: float):
    """Compare each row with the next ``WINDOW`` of its sorted partition. The first and
    last rows of the partition go along, for the windows that reach over its borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        schema = pa.schema(
            [("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("place", pa.int32()), ("side", pa.int32()), ("nth", pa.int32()), ("seam", pa.int32()),
             ("size", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("weight", pa.int64()), ("radius", pa.float64())]
        )

        def pairs(columns) -> pa.RecordBatch:
            n = len(columns[0])
            found = [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32))]
            return pa.RecordBatch.from_arrays([*found, *(pa.nulls(n, f.type) for f in list(schema)[3:])], schema=schema)

        def borders(table: pa.Table, side: int) -> pa.RecordBatch:
            n = len(table)
            fixed = [*(pa.array(np.full(n, x, np.int32)) for x in (place, side)), pa.array(np.arange(n, dtype=np.int32))]
            own = [table.column(c).combine_chunks() for c in ("turn", "size", "vec_id", "embedding", "weight", "radius")]
            columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *fixed, *own]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        tail: pa.Table | None = None
        first = True
        table = None
        for table, goes_on in _groups(batches):
            if first:
                yield borders(table.slice(0, WINDOW), 1)
                first = False
            fresh = 0
            if tail is not None:
                fresh = len(tail)
                table = pa.concat_tables([tail, table])
            units = unit(_stack(table.column("embedding")))
            ids, radii = np.asarray(table.column("vec_id")), np.asarray(table.column("radius"))
            yield pairs(_pair_rows(ids, units, radii, WINDOW, threshold, fresh))
            tail = table.slice(max(0, len(table) - WINDOW)) if goes_on else None
        if table is not None:
            yield borders(table.slice(max(0, len(table) - WINDOW)), 0)

    return run


def _seams(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The last rows of one partition against the first rows of the next."""
        group = group.sort_values("nth", kind="stable")
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        out = []
        if len(left) and len(right):
            units = [unit(np.stack(x["embedding"].to_numpy())) for x in (left, right)]
            kind = _compare(*units, left["radius"].to_numpy(), right["radius"].to_numpy(), threshold)
            gap = np.arange(len(right))[None, :] + np.arange(len(left), 0, -1)[:, None]
            kind[gap > WINDOW] = 0
            i, j = np.nonzero(kind)
            x, y = left["vec_id"].to_numpy()[i], right["vec_id"].to_numpy()[j]
            out = np.stack([np.minimum(x, y), np.maximum(x, y), kind[i, j]], axis=1)
        return pd.DataFrame(out, columns=["a", "b", "kind"]).astype({"a": "int64", "b": "int64", "kind": "int32"})

    return run


def _blocks(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Two blocks of one component, or one with itself."""
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        same = len(right) == 0
        right = left if same else right
        out = []
        if len(left):
            units = [unit(np.stack(x["embedding"].to_numpy())) for x in (left, right)]
            kind = _compare(*units, left["radius"].to_numpy(), right["radius"].to_numpy(), threshold)
            if same:
                kind = np.triu(kind, 1)
            i, j = np.nonzero(kind)
            x, y = left["leader"].to_numpy()[i], right["leader"].to_numpy()[j]
            out = np.stack([np.minimum(x, y), np.maximum(x, y), kind[i, j]], axis=1)
        return pd.DataFrame(out, columns=["a", "b", "kind"]).astype({"a": "int64", "b": "int64", "kind": "int32"})

    return run


def _member_links(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between the members of two balls: how many each has in the other."""
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        hit = unit(np.stack(left["embedding"].to_numpy())) @ unit(np.stack(right["embedding"].to_numpy())).T >= threshold
        counts = np.concatenate([hit @ right["weight"].to_numpy(), left["weight"].to_numpy() @ hit])
        return pd.DataFrame(
            {
                "vec_id": np.concatenate([left["vec_id"], right["vec_id"]]),
                "links": counts.astype("int64"),
                "a": group["a"].iloc[0],
                "b": group["b"].iloc[0],
            }
        )[counts > 0]

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, ...)``: vec_id, n_links,
    component_id, kept.

    A vector that is null, empty or zero, or holds a null or a component that isn't finite,
    links with nothing; vectors of different lengths don't link either. Rows that share a
    vec_id are counted as the separate rows they are. A row with a null vec_id links with
    nothing, has a null component_id and is kept. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    half = math.acos(threshold) / 2
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    good = rows.where(F.coalesce(usable, F.lit(False))).withColumn("same", F.xxhash64("embedding"))
    # Equal vectors, by two hashes.
    good = good.withColumn("same2", F.xxhash64(F.lit(1), "embedding"))
    firsts = good.groupBy("same", "same2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    firsts = materialize(firsts, "firsts")
    reps = materialize(
        good.join(firsts, ["same", "same2"]).where("vec_id = rep").groupBy("vec_id", "same", "same2")
        .agg(F.any_value("embedding").alias("embedding"), F.any_value("weight").alias("weight"))
        .select("vec_id", "embedding", "weight", F.lit(0.0).alias("radius")),
        "reps",
    )
    names = "turn int, size int, code long, vec_id long, embedding array<double>, weight long, radius double"
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_reps = reps.count()
    order = ["turn", "size", "code", "vec_id"]
    # A partition holds many windows' worth of rows.
    parts = lambda n: max(1, min(many, n // (8 * BLOCK)))
    balls = materialize(
        reps.mapInArrow(_coded(range(1)), names).repartitionByRange(parts(n_reps), *order).sortWithinPartitions(*order)
        .mapInArrow(_balls(half), "vec_id long, leader long, angle double"),
        "balls",
    )
    members = materialize(reps.drop("radius").join(balls, "vec_id"), "members")
    shape = balls.join(reps.select("vec_id", "weight"), "vec_id").groupBy("leader").agg(
        F.sum("weight").alias("weight"), F.max("angle").alias("radius"), F.min("vec_id").alias("least")
    )
    leaders = materialize(
        reps.select(F.col("vec_id").alias("leader"), "embedding").join(shape, "leader"), "leaders"
    )
    n_leaders = leaders.count()
    windowed = materialize(
        leaders.select(F.col("leader").alias("vec_id"), "embedding", "weight", "radius")
        .mapInArrow(_coded(range(1, PASSES + 1)), names)
        .repartitionByRange(parts(n_leaders * PASSES), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(_windows(threshold), _WINDOWED),
        "windowed",
    )
    borders = windowed.where("a is null").withColumn("place", F.col("place") + F.when(F.col("side") == 0, 1).otherwise(0))
    seams = borders.groupBy("place", "seam", "size").applyInPandas(_seams(threshold), _PAIRS)
    found = windowed.where("a is not null").select("a", "b", "kind").unionByName(seams).distinct()
    pairs = materialize(found, "pairs")
    opened = _opened(pairs.where("kind = 2"), members, threshold)
    linked = pairs.where("kind = 1").select("a", "b").unionByName(opened.select("a", "b").distinct())
    groups = materialize(components(linked), "groups")

    # All balls of a component are compared, in blocks; one of two balls has its only pair.
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dense = groups.join(sizes, "component").select("component", F.col("node").alias("leader"), "blocks")
    block = F.pmod(F.xxhash64("leader"), F.col("blocks")).cast("int")
    sides = dense.withColumn("block", block).select(
        "leader", "component",
        F.explode(F.expr("transform(sequence(0, blocks - 1), o -> struct(least(block, o) as i, greatest(block, o) as j, if(o >= block, 0, 1) as side))")).alias("w"),
    )
    blocks = (
        sides.select("leader", "component", "w.i", "w.j", "w.side")
        .join(leaders.select("leader", "embedding", "radius"), "leader")
        .groupBy("component", "i", "j")
        .applyInPandas(_blocks(threshold), _PAIRS)
    )
    extra = materialize(blocks.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "extra")
    opened_more = _opened(extra.where("kind = 2"), members, threshold)

    whole = pairs.unionByName(extra).where("kind = 1")
    per_ball = (
        whole.select(F.explode(F.array(F.struct(F.col("a").alias("leader"), F.col("b").alias("other")), F.struct(F.col("b").alias("leader"), F.col("a").alias("other")))).alias("e"))
        .select("e.leader", "e.other")
        .join(leaders.select(F.col("leader").alias("other"), "weight"), "other")
        .groupBy("leader")
        .agg(F.sum("weight").alias("outside"))
    )
    per_member = opened.unionByName(opened_more).groupBy("vec_id").agg(F.sum("links").alias("partly"))
    least = (
        leaders.join(groups, F.col("leader") == F.col("node"), "left")
        .select("leader", "least", F.coalesce("component", "leader").alias("group"))
    )
    smallest = least.groupBy("group").agg(F.min("least").alias("component_id"))
    described = (
        members.select("vec_id", "leader")
        .join(leaders.select("leader", F.col("weight").alias("inside")), "leader")
        .join(least.select("leader", "group"), "leader")
        .join(smallest, "group")
        .join(per_ball, "leader", "left")
        .join(per_member, "vec_id", "left")
        .select(
            F.col("vec_id").alias("rep"),
            "component_id",
            (F.col("inside") - 1 + F.coalesce("outside", F.lit(0)) + F.coalesce("partly", F.lit(0))).alias("n_links"),
        )
    )
    described = materialize(described, "described")
    key = F.struct("same", "same2")
    known = firsts.select(key.alias("_k"), "rep").join(described, "rep").select("_k", "component_id", "n_links")
    usable_rows = good.select("vec_id", key.alias("_k")).join(known, "_k").select("vec_id", "n_links", "component_id")
    others = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(windowed, pairs, extra, members, balls)
    result = usable_rows.unionByName(others)
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _opened(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Compare the members of pairs of balls that the bounds leave open: ``vec_id, links,
    a, b`` for members with links."""
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("leader"), F.lit(0).alias("side")), F.struct(F.col("b").alias("leader"), F.lit(1).alias("side")))).alias("s"))
    rows = sides.select("a", "b", "s.leader", "s.side").join(members.select("vec_id", "embedding", "weight", "leader"), "leader")
    out = rows.groupBy("a", "b").applyInPandas(_member_links(threshold), "vec_id long, links long, a long, b long")
    return materialize(out, "opened")
