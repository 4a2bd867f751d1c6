"""Relevance of projects to listings, and request texts built from them."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listingflow.functions.text import relevance_tokens, render, short_digest, text_or_empty
from listingflow.operators.once import once
from listingflow.scratch import materialize

# Tokens of one pattern, and the characters of a token that its pattern branches by.
PIECE = 1 << 14
NESTED = 9


def longest_at(tokens: list[str]) -> str:
    """A pattern whose group 1 is the longest of ``tokens`` that begins at a place.

    It matches ahead, so tokens that overlap are found too. Tokens share their first
    characters in nested branches, those of most tokens first.
    """

    def branch(words: list[str], depth: int) -> str:
        if depth == 0 or len(words) == 1:
            by_length = sorted(words, key=len, reverse=True)
            return "(?:" + "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in by_length) + ")"
        starts = [(c, [w[1:] for w in g]) for c, g in groupby((w for w in words if w), key=lambda w: w[0])]
        starts.sort(key=lambda start: -len(start[1]))
        parts = [("\\" if c in "+." else "") + c + branch(rest, depth - 1) for c, rest in starts]
        return "(?:" + "|".join(parts + [""] * ("" in words)) + ")"

    return f"(?=({branch(sorted(tokens), NESTED)}))"


def _with_prefixes(vocabulary: DataFrame) -> DataFrame:
    """``(token, ids)``: the ids of all tokens that a token begins with, its own among them."""
    lengths = vocabulary.agg(F.collect_set(F.length("token"))).scalar()
    starts = once(vocabulary.select("token"), {"_lengths": lengths}).select(
        "token", F.explode(F.filter("_lengths", lambda n: n <= F.length("token"))).alias("n")
    )
    known = vocabulary.select(F.col("token").alias("start"), "token_id")
    return starts.withColumn("start", F.substring("token", F.lit(1), F.col("n"))).join(known, "start").groupBy("token").agg(
        F.collect_list("token_id").alias("ids")
    )


def _found_sets(docs: DataFrame, vocabulary: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, found)``: the ids of the tokens that are part of each document, sorted.

    Only the texts are shuffled: rows are dealt to all tasks by a hash, and the rows of words
    and tokens that they unfold to stay in the task and are collected there again. A text is
    cut into its different words, which are searched for the longest token that begins at
    each place; the others that begin there are what that token begins with. Rows of
    one ``doc_id`` with different texts are brought together by their found tokens.
    """
    tokens = [r["token"] for r in vocabulary.select("token").collect()]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.withColumn("row", F.xxhash64("doc_id", "text")).repartition("row")
    words = F.array_join(F.array_distinct(F.split(F.lower(text_or_empty("text")), " ")), " ")
    searched = once(dealt.select("doc_id", "row", words.alias("words")), {"_w": F.col("words")}) if len(tokens) > PIECE else dealt.withColumn("_w", words)
    longest = [
        F.regexp_extract_all("_w", F.lit(longest_at(tokens[i : i + PIECE])), F.lit(1)) for i in range(0, len(tokens), PIECE)
    ]
    every = F.array_distinct(F.concat(*longest)) if longest else F.array().cast("array<string>")
    inside = materialize(_with_prefixes(vocabulary), "prefixes")
    # A document without a token keeps a row.
    hits = searched.select("doc_id", "row", F.explode_outer(every).alias("token")).join(inside, "token", "left")
    found = materialize(
        hits.groupBy("row", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("found"))
        .select(F.struct("doc_id").alias("_k"), "doc_id", "found"),
        "found",
    )
    repeated = materialize(found.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k"), "repeated")
    single = found.join(repeated, "_k", "left_anti").select("doc_id", "found")
    merged = (
        found.join(repeated, "_k", "left_semi").select("doc_id", F.explode_outer("found").alias("token_id"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("token_id")).alias("found"))
    )
    return single.unionByName(merged)


def _shared(a, b) -> Column:
    return F.size(F.array_intersect(a, b))


def rank_projects(
    docs: DataFrame,
    projects: DataFrame,
    k: int,
    doc_id: str = "doc_id",
    text: str = "text",
    order: str = "project_ord",
    project_text: str = "project_text",
) -> DataFrame:
    """The ``k`` most relevant projects per document: (doc_id, rank, project, relevance).

    Relevance is the number of distinct project tokens contained in the text; ties keep the
    project order, by which projects without a common token follow. Rows of one ``doc_id``
    count as one document.

    Documents with equal token sets are ranked once. A set looks its tokens up in an
    inverted index and counts the projects it meets, combined before the shuffle. The
    tokens of most projects come first in a set, and as many of these are left out of the
    look-up as a project could have and still be below the ``k`` projects of most tokens,
    whose relevance is counted beforehand; a project that has nothing else in common cannot
    be among the best. What the left out tokens add is counted only for projects that reach
    the ``k``-th best with all of them.
    """
    words = materialize(projects.select(F.col(order).alias("project"), relevance_tokens(project_text).alias("tokens")), "projects")
    tokens = words.select("project", F.explode("tokens").alias("token"))
    # In an order of falling frequency, which the ids then have too.
    vocabulary = materialize(
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "token")
        .select("token", F.monotonically_increasing_id().alias("token_id")),
        "vocabulary",
    )
    postings = materialize(tokens.join(vocabulary, "token").select("token_id", "project"), "postings")
    described = postings.groupBy("project").agg(F.sort_array(F.collect_list("token_id")).alias("has"))

    found = _found_sets(docs, vocabulary, doc_id, text).select(
        # Never null, so that all that is read of the sets is read from one shuffle.
        "doc_id", F.coalesce(short_digest(F.array_join("found", ",")), F.lit(b"")).alias("set"), "found"
    )
    # From here on rows lie by their set, and what they unfold to is counted and ranked where it is.
    distinct = found.groupBy("set").agg(F.any_value("found").alias("found"))
    seeds = described.orderBy(F.size("has").desc(), "project").limit(k).agg(F.collect_list("has")).scalar()
    floor = F.when(F.size("_seeds") < k, 0).otherwise(
        F.array_min(F.transform("_seeds", lambda has: _shared(has, F.col("found"))))
    )
    bounded = once(once(distinct, {"_seeds": seeds}), {"floor": floor})
    left_out = F.greatest(F.col("floor") - 1, F.lit(0))
    sets = bounded.select(
        "set", "floor", F.slice("found", F.lit(1), left_out).alias("left_out"),
        F.slice("found", left_out + 1, F.size("found")).alias("looked_up"),
    )

    met = (
        sets.select("set", F.explode("looked_up").alias("token_id"))
        .join(postings, "token_id")
        .groupBy("set", "project")
        .agg(F.count(F.lit(1)).cast("int").alias("part"))
    )
    of_set = Window.partitionBy("set")
    place = F.row_number().over(of_set.orderBy(F.col("part").desc()))
    reach = met.withColumn("_r", place).withColumn("kth", F.max(F.when(F.col("_r") == k, F.col("part"))).over(of_set))
    reached = lambda least: F.col("part") + F.size("left_out") >= least
    relevance = F.col("part") + _shared("has", "left_out")
    near = (
        reach.join(sets.select("set", "floor", "left_out").hint("merge"), "set")
        .where(reached(F.greatest("floor", F.coalesce("kth", F.lit(0)))))
        .join(described, "project")
        .select("set", "project", "part", "left_out", F.when(F.col("_r") <= k, relevance).alias("sure"))
    )
    # What the k projects of most looked up tokens reach leaves few others to be compared.
    least = F.when(F.count("sure").over(of_set) == k, F.min("sure").over(of_set))
    exact = (
        near.withColumn("least", F.coalesce(least, F.lit(0))).where(reached(F.col("least")))
        .join(described, "project").select("set", "project", F.coalesce("sure", relevance).alias("relevance"))
    )
    w = of_set.orderBy(F.col("relevance").desc(), "project")

    def best(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    first = words.select("project").orderBy("project").limit(k).agg(F.collect_list("project")).scalar()
    # Only where the bound is nothing can a project without a common token be among the best.
    none = sets.where("floor = 0").select("set", F.explode(first).alias("project"), F.lit(0).alias("relevance"))
    scored = best(exact).drop("rank").unionByName(none).groupBy("set", "project").agg(F.max("relevance").alias("relevance"))
    ranked = best(scored).select(F.struct("set").alias("_k"), "rank", "project", "relevance")
    of = found.select(F.col("doc_id").alias(doc_id), F.struct("set").alias("_k"))
    return of.join(ranked.hint("merge"), "_k").select(doc_id, "rank", "project", "relevance")


def project_block(
    title: Column, technologies: Column, description: Column, impact: Column, url: Column,
    number: Column, link_name: str = "GitHub",
) -> Column:
    """The lines that describe one project."""
    return render(
        "Project {n}: {title}\nTechnologies: {tech}\n- {desc}\n- {impact}\n" + link_name + ": {url}",
        {"n": number.cast("string"), "title": title, "tech": technologies, "desc": description,
         "impact": impact, "url": url},
    )


def project_texts(ranked: DataFrame, projects: DataFrame, doc_id: str = "doc_id", order: str = "project_ord", link_name: str = "GitHub") -> DataFrame:
    """One text per document that lists its ranked projects. A document has as many
    rows as were asked for, so collecting them is bounded."""
    p = projects.withColumnRenamed(order, "project")
    # Dealt by document before the long texts are there, which are then collected where they are.
    joined = ranked.repartition(F.col(doc_id)).join(p, "project")
    block = project_block(
        F.col("title"), F.col("technologies"), F.col("description"), F.col("impact"),
        F.col("url"), F.col("rank"), link_name,
    )
    lines = joined.select(doc_id, F.struct("rank", block.alias("block")).alias("b"))
    ordered = lines.groupBy(doc_id).agg(F.sort_array(F.collect_list("b")).alias("_b"))
    return ordered.select(
        doc_id, F.array_join(F.transform("_b", lambda x: x["block"]), "\n").alias("projects_text")
    )


def requests(df: DataFrame, template: str, values: dict[str, str], name: str = "request") -> DataFrame:
    """Add a request text per row, from a template of the caller."""
    return df.withColumn(name, render(template, {k: F.col(v) for k, v in values.items()}))
