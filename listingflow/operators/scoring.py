"""Scoring listings against one profile or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.functions import score as S
from listingflow.functions.score import ScoreRules
from listingflow.operators.once import once
from listingflow.scratch import materialize

SCORE_COLUMNS = [
    "score", "reason", "role_score", "skills_score", "experience_score",
    "location_score", "recency_score",
]


def _is_date(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.DateType)


def profile_table(profiles: DataFrame, rules: ScoreRules, text: str = "text") -> DataFrame:
    """Features of each profile, computed once per profile."""
    return profiles.withColumn("features", S.profile_features(text, rules))


def text_bodies(texts: DataFrame, rules: ScoreRules, text: str = "text", body: str = "body") -> DataFrame:
    """``texts`` with what scores need to know of each text in place of the text.

    Where many descriptions begin with one text, it is read once here, and listings carry
    its ``body`` and, as ``note``, what follows it after a space.
    """
    normal = once(texts, {"_norm": S.normalize_score(text)})
    return once(normal, {body: S.body_features(F.col("_norm"), F.col(text).isNotNull(), rules)}).drop("_norm", text)


def _described(
    listings: DataFrame, rules: ScoreRules, as_of: Column, posted: str, body: str | None
) -> tuple[DataFrame, Column, Column]:
    """Listings with ``_lexicon``, ``_need`` (years asked), ``_place`` and ``_fresh`` (their
    parts), the roles hit, and the lexicon's terms found, with their bits, in the description
    or in ``body`` and ``note``.

    The last two are loops over terms. Spark doesn't compile loops, and works out again for
    each term what they search, so texts are made before, in columns of their own.
    """
    title, description = S.normalized_texts("title", "description")
    index = F.col("_lexicon")
    common = {"_title": title, "_where": S.normalize_score("location"), "_lexicon": S.lexicon_index("category", rules)}
    if body is None:
        # Long texts are normalised and searched once per row.
        texts = once(listings, {**common, "_desc": description})
        desc = F.col("_desc")
        texts = once(texts, {"_both": F.concat_ws(" ", "_title", "_desc"), "_digits": S.first_years(desc)})
        hits = S.role_hits(F.col("_both"), rules)
        terms = F.filter(F.get(S._tagged_lexicons(rules), index), lambda s: F.contains(desc, s["t"]))
    else:
        b, note, ends = F.col(body), F.col("_note"), F.col("_ends")
        # A missing text makes the whole description missing.
        noted = F.when(b["present"], S.normalize_score("note")).otherwise(F.lit(""))
        texts = once(listings, {**common, "_note": noted})
        texts = once(texts, {"_ends": S.joined(b["tail"], note), "_digits": S.body_first_years(b, note)})
        texts = once(texts, {"_near": S.body_near(F.col("_title"), b, ends, rules), "_roles": b["roles"], "_masks": b["terms"]})
        hits = S.body_role_hits(F.col("_roles"), F.col("_near"), rules)
        terms = S.body_lexicon_hits(F.col("_masks"), ends, index, rules)
    parts = {
        "_need": S.years_or_default(F.col("_digits"), rules),
        "_place": S.location_part(F.col("_where"), rules),
        "_fresh": S.recency_part(S.posted_date(posted, _is_date(listings, posted)), as_of),
    }
    return once(texts, parts), hits, terms


def score_listings(
    listings: DataFrame,
    profile: DataFrame,
    rules: ScoreRules,
    as_of: Column,
    text: str = "text",
    posted: str = "posted",
    body: str | None = None,
) -> DataFrame:
    """Add the score, its five parts and the reason to every listing.

    ``profile`` holds exactly one row. Its features reach the listings as a scalar
    subquery: there is no join and no shuffle, and two rows raise an error. ``body`` names
    the column of ``text_bodies`` of listings that have it, with ``note``, instead of a
    description; both are left out of the result.
    """
    features = profile.select(S.profile_features(text, rules).alias("f")).scalar()
    # What follows the texts is arithmetic on the outcome, so a later filter on the score
    # copies nothing costly.
    texts, hits, terms = _described(listings, rules, as_of, posted, body)
    texts = once(texts, {"_p": features})
    p = F.col("_p")
    known = F.get(p["known"], F.col("_lexicon"))
    parts = once(
        texts,
        {
            "_hits": hits,
            "_found": F.transform(F.filter(terms, lambda s: F.array_contains(known, s["t"])), lambda s: s["t"]),
        },
    )
    parts = once(parts, {"_size": S.lexicon_size(F.col("_lexicon"), rules)})
    flags = [F.col("_hits")[i] for i in range(len(rules.roles))]
    matched = F.size("_found")
    parts = once(
        parts,
        {
            "_matched": matched,
            "_role": S.weighted(S.role_part(flags, p["role_values"]), rules.role_weight),
            "_skill": S.weighted(
                matched.cast("double") / F.greatest(F.col("_size"), F.lit(1)), rules.skills_weight
            ),
            "_exp": S.weighted(S.experience_part(p["years"], F.col("_need")), rules.experience_weight),
            "_loc": S.weighted(F.col("_place"), rules.location_weight),
            "_rec": S.weighted(F.col("_fresh"), rules.recency_weight),
        },
    )
    shown = F.array_join(F.slice("_found", 1, rules.shown_skills), ", ")
    skill_note = F.when(F.col("_matched") == 0, F.lit("No skill match")).otherwise(
        F.concat(
            F.lit("Matched "), F.col("_matched").cast("string"), F.lit("/"),
            F.col("_size").cast("string"), F.lit(" skills: "), shown,
        )
    )
    reason = F.concat(
        F.lit("Role: "), S.role_detail(flags, p["role_values"], rules),
        F.lit(" | Skills: "), skill_note,
        F.lit(" | Exp: CV: ~"), p["years"], F.lit("yrs, Required: ~"), F.col("_need"), F.lit("yrs"),
    )
    total = S.total_score(*[F.col(c) for c in ("_role", "_skill", "_exp", "_loc", "_rec")])
    return parts.select(
        *[c for c in listings.columns if body is None or c not in (body, "note")],
        total.alias("score"),
        reason.alias("reason"),
        S.two_decimals(F.col("_role")).alias("role_score"),
        S.two_decimals(F.col("_skill")).alias("skills_score"),
        S.two_decimals(F.col("_exp")).alias("experience_score"),
        S.two_decimals(F.col("_loc")).alias("location_score"),
        S.two_decimals(F.col("_rec")).alias("recency_score"),
    )


def score_entries(scored: DataFrame) -> DataFrame:
    """The columns a score cache keeps."""
    return scored.select(
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company", F.lit("")).alias("company"),
        F.coalesce("category", F.lit("N/A")).alias("category"),
        *SCORE_COLUMNS,
    )


def constant_scores(listings: DataFrame, threshold: float) -> DataFrame:
    """Skip scoring: every listing passes with the threshold as its score."""
    return listings.withColumn("score", F.lit(float(threshold)))


#: Years asked from which on listings share a cell; it bounds the number of cells.
MOST_YEARS = 40


def _signatures(
    listings: DataFrame, rules: ScoreRules, as_of: Column, k: int, posted: str, ord_col: str, body: str | None = None
) -> DataFrame:
    """Listings by all that their score depends on, each with its ``k`` earliest rows."""
    long_text = ["description"] if body is None else [body, "note"]
    texts, hits, terms = _described(
        listings.select(ord_col, "category", "location", posted, "title", *long_text), rules, as_of, posted, body
    )
    signature = once(texts, {"roles": hits, "_terms": terms})
    signature = once(
        signature.withColumnsRenamed({"_lexicon": "lexicon", "_need": "need", "_place": "place", "_fresh": "fresh"}),
        {"skills": S.packed(F.col("_terms"), rules)},
    )
    sig_cols = ["roles", "lexicon", "skills", "need", "place", "fresh"]
    # Limited per task before the shuffle. Rows of one signature differ in ``ord`` only, so
    # the first ``ord`` names the group.
    w = Window.partitionBy(*sig_cols).orderBy(F.col(ord_col))
    earliest = signature.select(*sig_cols, ord_col, F.row_number().over(w).alias("_n")).where(F.col("_n") <= k)
    named = F.aggregate("skills", F.lit(0), lambda n, word: n + F.bit_count(word))
    return materialize(
        earliest.groupBy(*sig_cols)
        .agg(F.min(ord_col).alias("first_ord"), F.sort_array(F.collect_list(ord_col)).alias("ords"))
        .withColumn("named", named),
        "signatures",
    )


def _cell() -> Column:
    """What bounds a signature's score for a profile, besides which of the skills it names."""
    return F.struct(
        "roles", "lexicon", F.least(F.col("need").cast("double"), F.lit(MOST_YEARS)).alias("years"), "place", "fresh", "named"
    )


def _pair_score(listing, profile, matched: Column, rules: ScoreRules) -> Column:
    """Score of a listing with the fields ``roles, lexicon, need, place, fresh`` for a
    profile with ``role_values, years``, of whose skills it names ``matched``."""
    flags = [listing["roles"][i] for i in range(len(rules.roles))]
    size = F.greatest(S.lexicon_size(listing["lexicon"], rules), F.lit(1))
    return S.total_score(
        S.weighted(S.role_part(flags, profile["role_values"]), rules.role_weight),
        S.weighted(matched.cast("double") / size, rules.skills_weight),
        S.weighted(S.experience_part(profile["years"], listing["need"]), rules.experience_weight),
        S.weighted(listing["place"], rules.location_weight),
        S.weighted(listing["fresh"], rules.recency_weight),
    )


def _matched(listing, known: Column, rules: ScoreRules) -> Column:
    """How many of the skills that a listing names a profile knows."""
    matched = F.lit(0)
    for i in range(S.mask_words(rules)):
        matched = matched + F.bit_count(F.get(known, listing["lexicon"])[i].bitwiseAND(listing["skills"][i]))
    return matched


class _Columns:
    """Columns of a frame, by name, where a struct's fields are asked for."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def wanted_cells(groups: DataFrame, kinds: DataFrame, rules: ScoreRules, k: int) -> DataFrame:
    """``kinds`` with ``_cell``, each cell that can hold one of the best ``k`` listings of the
    kind, and ``_least``, a score that the ``k``-th best reaches for certain.

    Signatures lie in cells of equal bound: a listing can't match more skills than it names
    or the profile knows. The number of cells is bounded by the rules. Each kind walks over
    the cells alone: one signature of each is scored, and the ``k``-th best of these listings
    is reached by the answer. Cells whose bound doesn't reach it are left out.
    """
    celled = groups.withColumn("_cell", _cell())
    # The signature of a cell that is scored: any would do.
    one = F.min_by(F.struct("skills", "need", F.size("ords").alias("n")), "first_ord")
    cells = celled.groupBy("_cell").agg(one.alias("one"), F.min(F.struct(F.col("need").cast("double").alias("least"), "need")).alias("need"))
    directory = cells.agg(F.collect_list(F.struct("_cell", "one", F.col("need.need").alias("need")))).scalar()
    p = _Columns()

    def walked(c: Column) -> Column:
        cell = c["_cell"]
        sample = {"roles": cell["roles"], "lexicon": cell["lexicon"], "place": cell["place"], "fresh": cell["fresh"]}
        known = F.aggregate(F.get("known", cell["lexicon"]), F.lit(0), lambda n, word: n + F.bit_count(word))
        most = _pair_score({**sample, "need": c["need"]}, p, F.least(cell["named"], known), rules)
        first = {**sample, "need": c["one"]["need"], "skills": c["one"]["skills"]}
        reached = _pair_score(first, p, _matched(first, F.col("known"), rules), rules)
        return F.struct(cell.alias("cell"), most.alias("most"), reached.alias("reached"), c["one"]["n"].alias("n"))

    bounded = once(once(kinds, {"_cells": directory}), {"_walk": F.transform("_cells", walked)})
    reached = F.flatten(F.transform("_walk", lambda w: F.array_repeat(w["reached"], w["n"])))
    bounded = once(bounded, {"_least": F.coalesce(F.get(F.sort_array(reached, asc=False), F.lit(k - 1)), F.lit(0.0))})
    return bounded.select(
        "kind", "role_values", "years", "known", "_least",
        F.explode(F.filter("_walk", lambda w: w["most"] >= F.col("_least"))["cell"]).alias("_cell"),
    )


def candidates(groups: DataFrame, kinds: DataFrame, rules: ScoreRules, k: int) -> DataFrame:
    """``(kind, first_ord, score, ords)`` of the signatures in the cells that a kind wants,
    joined by equality, as far as they reach the kind's least score."""
    p = _Columns()
    celled = groups.withColumn("_cell", _cell()).drop("named")
    pairs = wanted_cells(groups, kinds, rules, k).join(celled, "_cell")
    scored = once(pairs, {"score": _pair_score(p, p, _matched(p, F.col("known"), rules), rules)})
    return scored.where("score >= _least").select("kind", "first_ord", "score", "ords")


def top_per_profile(
    listings: DataFrame,
    profiles: DataFrame,
    rules: ScoreRules,
    as_of: Column,
    k: int,
    profile_id: str = "profile_id",
    text: str = "text",
    posted: str = "posted",
    ord_col: str = "ord",
    body: str | None = None,
) -> DataFrame:
    """The best ``k`` listings of every profile: (profile_id, rank, ord, score).

    A score depends on a listing only through a small signature (roles hit, skills
    named, years asked, place and freshness), and on a profile only through its
    features. So listings are reduced to distinct signatures and profiles to distinct
    kinds, and a kind is compared only with signatures whose bound reaches what its
    answer reaches for certain (``wanted_cells``). The reduction is exact: the best
    ``k`` listings of a profile lie in its best ``k`` signatures ordered by score and
    first ``ord``, and within a signature they are its ``k`` earliest rows.
    """
    groups = _signatures(listings, rules, as_of, k, posted, ord_col, body)
    features = profile_table(profiles, rules, text).select(
        profile_id, F.col("features")["role_values"].alias("role_values"),
        S.known_masks(F.col("features")["known"], rules).alias("known"),
        F.col("features")["years"].alias("years"),
    )
    feature_cols = ["role_values", "years", "known"]
    features = features.withColumn("digest", F.sha2(F.to_json(F.struct(*feature_cols)), 256))
    # One profile stands for all with the same features; they are never collected.
    # They are dealt to all tasks: each walks over all cells.
    parts = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = materialize(
        features.groupBy("digest", *feature_cols).agg(F.min(profile_id).alias("kind")).repartition(parts), "profiles"
    )

    best = Window.partitionBy("kind").orderBy(F.col("score").desc(), F.col("first_ord"))
    top_groups = (
        candidates(groups, kinds.drop("digest"), rules, k)
        .withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    )
    rows = top_groups.select("kind", "score", F.explode("ords").alias(ord_col))
    rank = Window.partitionBy("kind").orderBy(F.col("score").desc(), F.col(ord_col))
    ranked = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    answers = ranked.join(kinds.select("kind", "digest"), "kind")
    return features.select(profile_id, "digest").join(answers, "digest").select(
        profile_id, "rank", ord_col, "score"
    )
