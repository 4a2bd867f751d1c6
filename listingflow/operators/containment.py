"""Which terms of a table are part of which texts, through an index of rare anchors.

Texts give each of their runs of ``GRAM`` characters once, with its place. A term is filed
under the one of its runs that the texts have least often; a term with a run that no text
has is dropped at once. Where a text has a term's anchor, the text around that place is
compared with the term. So intermediate rows are about as many as the texts have
characters, whatever the number of terms and their lengths, and a frequent run is looked up
only for terms that have nothing rarer.

The texts' runs are many times as large as the file they are made from, by whose size Spark
would judge them. So they only ever stand on the left of a semi join, which leaves the runs
of terms and can broadcast the terms alone, and what joins them to rows is a merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listingflow.operators.once import once
from listingflow.scratch import materialize

GRAM = 3


def numbered(texts: DataFrame, text: str = "text") -> DataFrame:
    """The different texts of a column, written once with a ``text_id``. They are dealt to as
    many files as a shuffle has parts: searching them costs far more than their size tells."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = texts.select(F.col(text).alias("text")).distinct().repartition(parts)
    return materialize(distinct.withColumn("text_id", F.monotonically_increasing_id()), "texts")


def grams(texts: DataFrame, sizes: Column) -> DataFrame:
    """``(text_id, gram, place)``: every run of ``GRAM`` characters with its place from 0,
    and the different shorter runs of the other ``sizes``, which are whole terms."""
    chars = once(
        texts.select("text_id", "text"),
        {"_chars": F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), "_sizes": sizes},
    )
    n = F.size("_chars")

    def runs(size: Column) -> Column:
        places = F.transform(
            F.sequence(F.lit(0), n - size),
            lambda i: F.struct(
                F.array_join(F.slice("_chars", i + 1, size), "").alias("gram"),
                F.when(size == GRAM, i).otherwise(F.lit(0)).alias("place"),
            ),
        )
        return F.when(size == GRAM, places).otherwise(F.array_distinct(places))

    every = F.flatten(F.transform(F.filter("_sizes", lambda size: size <= n), runs))
    return chars.select("text_id", F.inline(every))


def anchors(terms: DataFrame, found: DataFrame) -> DataFrame:
    """``(term, gram, offset)``: each of ``terms(term)`` under its rarest run among ``found``.
    Terms with a run that isn't found have no row."""
    size = F.least(F.length("term"), F.lit(GRAM))
    parts = terms.select("term", (F.length("term") - size + 1).alias("runs"), size.alias("size")).select(
        "term", "runs", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("offset"), "size"
    )
    parts = parts.withColumn("gram", F.substring("term", F.col("offset") + 1, F.col("size")))
    asked = found.join(parts.select("gram").distinct(), "gram", "left_semi")
    often = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = parts.join(often, "gram").groupBy("term", "runs").agg(
        F.min(F.struct("n", "offset", "gram")).alias("a"), F.count(F.lit(1)).alias("matched")
    )
    return rarest.where("matched = runs").select("term", "a.gram", "a.offset")


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct ``(text_id, term)`` where a text of ``texts(text_id, text)`` contains a
    term of ``terms(term)``. Both are compared as they are; empty and null terms and texts
    match nothing. ``texts`` is a written table: it is read for its runs and for the
    comparison."""
    terms = terms.select("term").where("length(term) > 0").distinct()
    sizes = terms.agg(F.collect_set(F.least(F.length("term"), F.lit(GRAM)))).scalar()
    found = grams(texts, sizes)
    filed = materialize(anchors(terms, found), "anchors")
    at_anchor = found.join(filed.select("gram").distinct(), "gram", "left_semi")
    near = at_anchor.join(filed.hint("merge"), "gram").where("place >= offset")
    whole = near.where(f"length(term) <= {GRAM}").select("text_id", "term")
    longer = near.where(f"length(term) > {GRAM}").select(
        F.struct("text_id").alias("_k"), "term", (F.col("place") - F.col("offset") + 1).alias("_from")
    )
    verified = (
        longer.join(texts.select(F.struct("text_id").alias("_k"), "text_id", "text").hint("merge"), "_k")
        .where(F.substring("text", F.col("_from"), F.length("term")) == F.col("term"))
        .select("text_id", "term")
    )
    return whole.unionByName(verified).distinct()
