"""Merkle dataset manifest by nested-interval labels (operator 13).

The leaves of a tree are numbered by their order. A node carries the interval of leaf
ranks that it covers, ``[lo, hi)``; a node is an ancestor of another exactly if its
interval contains the other's, and the siblings of a node are what remains of its parent's
children without the child that contains it.

Levels are bucketed: ``STRIDE`` levels at a time, nodes whose intervals lie in one run of
``ARITY ** STRIDE`` nodes share a block, whose inner nodes are built in its row. A join on
the block attaches all ancestors of these levels to the nodes below it, and the steps of
the block's own top node, found the same way one stride higher. So no key of a join has
more than ``ARITY ** STRIDE`` rows below it, whatever a source's share of the table, and
tables shrink by that factor from stride to stride.

The tree of all sources is built by the same functions over the sources' roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.operators.once import once
from listingflow.scratch import discard, materialize

ARITY = 3
#: Levels that one join attaches; a block has at most ARITY ** STRIDE nodes at its bottom.
STRIDE = 4

_STEPS = "array<struct<before: string, after: string>>"


def _field(value: Column) -> Column:
    """A null is ``-``; else the size in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """Leaf of a row of ``documents`` whose text is ``text``."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), text]
    return F.sha2(F.concat(*[_field(c) for c in fields]), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its steps give."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level and from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``lo``, their rank within ``tree``, and ``width``, the tree's size.

    ``rows`` is a written table: a row's file and place in it break the last ties, so that
    equal rows spread over ranges too. Ranges of the order are sorted each in its task; what
    comes before a range is added up from one row for each tree and range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "_file", "_row"]
    located = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = materialize(
        located.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_file", "_row")
        # The upper bits are the range, the lower ones the place in it.
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("_place", 33)
    heads = placed.groupBy("tree", part.alias("_part")).agg(F.min("_place").alias("_head"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        F.struct("tree", "_part").alias("_k"), "_head",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("width"),
    )
    return (
        placed.withColumn("_k", F.struct("tree", part.alias("_part")))
        .join(offsets, "_k")
        .withColumn("lo", F.col("_before") + F.col("_place") - F.col("_head"))
        .drop("_k", "_place", "_head", "_before")
    )


def _block(level: int) -> Column:
    """The block, above nodes of ``level``, that a node lies in."""
    return F.floor(F.col("lo") / ARITY ** (level + STRIDE)).alias("block")


def _blocks(nodes: DataFrame, level: int) -> DataFrame:
    """``tree, block, width, families, top``: for every block of ``nodes(tree, width, lo, hi,
    digest)`` its inner nodes with their children, and the node at its top; ``width`` is
    the number of the tree's nodes at the level of the top."""
    grouped = nodes.groupBy("tree", "width", _block(level)).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("row")
    )
    none = F.lit(None).cast("array<struct<lo: bigint, hi: bigint, children: array<struct<lo: bigint, hi: bigint, digest: string>>>>")
    built = grouped.select("tree", "block", "width", "row", F.coalesce(none, F.array()).alias("families"))
    for _ in range(STRIDE):
        more = F.col("width") > 1
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("row") - 1) / ARITY).cast("int")),
            lambda i: F.slice(F.col("row"), i * ARITY + 1, ARITY),
        )
        parents = F.transform(
            runs,
            lambda run: F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), run.alias("children")),
        )
        built = once(built, {"_new": F.when(more, parents)}).select(
            "tree", "block",
            F.when(more, F.ceil(F.col("width") / ARITY)).otherwise(F.col("width")).alias("width"),
            F.when(
                more,
                F.transform(
                    "_new",
                    lambda f: F.struct(
                        f["lo"].alias("lo"), f["hi"].alias("hi"),
                        F.sha2(F.array_join(F.transform(f["children"], lambda c: c["digest"]), ""), 256).alias("digest"),
                    ),
                ),
            ).otherwise(F.col("row")).alias("row"),
            F.when(more, F.concat("families", "_new")).otherwise(F.col("families")).alias("families"),
        )
    return built.select("tree", "block", "width", "families", F.col("row")[0].alias("top"))


def _own_steps() -> Column:
    """Steps of the node ``lo, hi`` through the ancestors among ``families``, lowest first:
    of each ancestor the children whose interval doesn't contain the node's."""
    def contains(n: Column) -> Column:
        return (n["lo"] <= F.col("lo")) & (n["hi"] >= F.col("hi"))

    def joined(children: Column) -> Column:
        return F.array_join(F.transform(children, lambda c: c["digest"]), "")

    return F.transform(
        F.filter("families", contains),
        lambda f: F.struct(
            joined(F.filter(f["children"], lambda c: c["hi"] <= F.col("lo"))).alias("before"),
            joined(F.filter(f["children"], lambda c: c["lo"] >= F.col("hi"))).alias("after"),
        ),
    )


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every stride over ``nodes``, written, and ``(tree, digest)`` of roots."""
    strides, level = [], 0
    while True:
        strides.append(materialize(_blocks(nodes, level), "blocks"))
        tops = strides[-1].select("tree", "width", "top.*")
        nodes, level = tops.where("width > 1"), level + STRIDE
        roots = tops.where("width = 1").select("tree", "digest")
        found = roots if level == STRIDE else found.unionByName(roots)
        if nodes.isEmpty():
            return strides, found


def _attached(leaves: DataFrame, strides: list[DataFrame], beyond: DataFrame) -> DataFrame:
    """``leaves`` with ``steps``, and the further columns of ``beyond(tree, steps, ...)``,
    which has the steps from the root of each tree upwards."""
    extra = [c for c in beyond.columns if c not in ("tree", "steps")]
    above = None
    for s in reversed(range(len(strides))):
        ended = strides[s].where("width = 1").select("tree", "block").join(beyond.withColumnRenamed("steps", "tail"), "tree")
        above = ended if above is None else above.unionByName(ended)
        key = F.struct("tree", "block")
        blocks = strides[s].select(key.alias("_k"), "families").join(above.select(key.alias("_k"), "tail", *extra), "_k")
        if s:
            below = strides[s - 1].where("width > 1").select("tree", F.col("block").alias("_own"), "top.lo", "top.hi")
        else:
            below = leaves
        below = below.withColumn("_k", F.struct("tree", _block(s * STRIDE)))
        steps = F.concat(_own_steps(), F.col("tail"))
        joined = below.join(blocks, "_k")
        if s == 0:
            return joined.select(*leaves.columns, steps.alias("steps"), *extra)
        above = joined.select("tree", F.col("_own").alias("block"), steps.alias("tail"), *extra)


def manifest(leaves: DataFrame) -> DataFrame:
    """Every row of ``leaves(doc_id, source, leaf, ...)`` with ``steps`` to the root, lowest
    first, each with the digests of the siblings before and after, ``subroot`` of its source
    and ``root``.

    Leaves of a source ascend by doc_id, null first; rows of equal doc_id by their leaf, so
    repeated rows are leaves of their own. A null source is a source. A lone leaf is its
    subroot. An empty table gives no rows. Other columns are carried along; their names are
    packed away meanwhile, but the names of the results are taken.
    """
    own = {"steps", "subroot", "root"} & set(leaves.columns)
    if own:
        raise ValueError(f"columns {sorted(own)} are results")
    rows = materialize(
        leaves.select(
            F.struct(F.col("source").cast("string").alias("source")).alias("tree"),
            F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"),
            F.struct(*leaves.columns).alias("row"),
        ),
        "leaves",
    )
    placed = ranked(rows, ["doc_id", "digest"]).select("tree", "width", "lo", (F.col("lo") + 1).alias("hi"), "digest", "row")
    strides, roots = _grown(placed.drop("row"))
    one = F.struct(F.lit(0).alias("all"))
    subroots = materialize(roots.select(one.alias("tree"), F.col("tree.source").alias("source"), "digest"), "subroots")
    tops = ranked(subroots, ["source"]).select("tree", "width", "lo", (F.col("lo") + 1).alias("hi"), "digest", "source")
    top_strides, top = _grown(tops.drop("source"))
    first = top.first()
    beyond = _attached(tops, top_strides, top.select("tree", F.array().cast(_STEPS).alias("steps"))).select(
        F.struct("source").alias("tree"), "steps", F.col("digest").alias("subroot")
    )
    done = _attached(placed, strides, beyond)
    discard(rows, subroots)
    return done.select("row.*", "steps", "subroot", F.lit(first["digest"] if first else None).cast("string").alias("root"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs(doc_id, text, lang, source, n_chars, ...)`` and what each row's
    proof says of a copy in which rows of even CRC-32 of their doc_id lost the line ends of
    their texts. A null doc_id isn't tampered with; other columns are not looked at."""
    text = F.col("text").cast("string")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even & F.contains(text, F.lit("\n")), leaf_digest(F.replace(text, F.lit("\n"), F.lit(""))))
    leaves = docs.select("doc_id", "source", leaf_digest(text).alias("leaf"), changed.alias("changed"))
    found = manifest(leaves).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("steps")))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root",
        proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
