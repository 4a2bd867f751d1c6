"""Scores by hand, and the many-profile form against the single-profile one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from listingflow.defaults import SCORE_RULES
from listingflow.functions import score as S
from listingflow.functions.score import ScoreRules
from listingflow.operators import scoring
from listingflow.operators.filters import at_least, recent_only, split_rejected
from listingflow.operators.scoring import constant_scores, score_entries, score_listings, top_per_profile
from listingflow.operators.topk import prefix_until, prefix_until_scored, ranked_top, top_groups, top_per_group
from listingflow.scratch import materialize


def as_of():
    return F.lit("2024-01-10").cast("date")


SCHEMA = "ord long, title string, company string, category string, location string, posted string, description string"
CV = "Data Analyst, sql python excel. 4+ years of experience in analytics"


def score(spark, rows, cv=CV, rules=SCORE_RULES):
    df = spark.createDataFrame(rows, SCHEMA)
    profile = spark.createDataFrame([(cv,)], "text string")
    return {r["ord"]: r for r in score_listings(df, profile, rules, as_of()).collect()}


def test_parts_by_hand(spark):
    rows = [
        (0, "Data Analyst", "c", "data_analyst", "Remote", "2024-01-10", "SQL and\nPython. 1-3 years"),
        (1, "Cook", "c", "unknown", "Pune (Hybrid)", "2024-1-9", "5 yrs"),
        (2, "Cook", "c", None, "remote, x", "2024-01", "6 years"),
        (3, "Cook", None, "finance_roles", "", "2025-01-01", "excel 20 years"),
        (4, "Cook", "c", "finance_roles", None, "2024-01-07", None),
    ]
    s = score(spark, rows)
    assert s[0]["role_score"] == 3.5 and s[0]["skills_score"] == 0.29
    assert s[0]["experience_score"] == 1.5 and s[0]["location_score"] == 1.0 and s[0]["recency_score"] == 0.5
    assert s[0]["score"] == 6.8
    assert s[0]["reason"] == (
        "Role: Role 'data analyst' matches CV | Skills: Matched 2/17 skills: sql, python | Exp: CV: ~4yrs, Required: ~3yrs"
    )
    assert (s[1]["experience_score"], s[1]["location_score"], s[1]["recency_score"]) == (1.05, 0.8, 0.4)
    assert s[1]["reason"].startswith("Role: No strong role match | Skills: No skill match")
    assert (s[2]["experience_score"], s[2]["location_score"], s[2]["recency_score"]) == (0.45, 0.5, 0.25)
    assert (s[3]["location_score"], s[3]["recency_score"]) == (1.0, 0.4)
    assert s[3]["skills_score"] == round(10 * 0.25 / 14, 2)
    assert s[4]["recency_score"] == 0.25 and "Required: ~2yrs" in s[4]["reason"]


def test_roles_cap_and_term_must_be_in_the_profile(spark):
    rules = ScoreRules({"r1": ("foo",), "r2": ("bar",), "r3": ("baz",)}, {"d": ("s1", "s2")}, "d")
    s = score(spark, [(0, "foo bar", "c", "d", "x", "", "s1 s2"), (1, "baz", "c", "d", "x", "", "s2")], "has foo and bar, s1", rules)
    assert s[0]["role_score"] == 3.5 and s[0]["skills_score"] == 1.25
    assert s[1]["role_score"] == 0.0 and s[1]["skills_score"] == 0.0
    assert "CV: ~3yrs" in s[0]["reason"] and s[0]["recency_score"] == 0.25


def test_two_profiles_are_an_error(spark):
    df = spark.createDataFrame([(0, "a", "b", "d", "", "", "")], SCHEMA)
    with pytest.raises(Exception):
        score_listings(df, spark.createDataFrame([("a",), ("b",)], "text string"), SCORE_RULES, as_of()).collect()


def random_listings(spark, n, seed):
    rnd = random.Random(seed)
    words = ["sql", "python", "excel", "llm", "rag", "audit", "sap", "kpi", "cook", "3 years", "8 yrs", "data analyst", "engineer"]
    # A third of the rows are the same listing.
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, "Data Analyst", "hot", "data_analyst", "Remote", "2024-01-10", "sql 2 years"))
        else:
            rows.append((i, rnd.choice(words), "c", rnd.choice(["data_analyst", "genai_llm", "x"]), rnd.choice(["", "a (hybrid)", "b"]),
                         rnd.choice(["2024-01-10", "2024-01-08", "bad"]), " ".join(rnd.sample(words, 4))))
    return spark.createDataFrame(rows, SCHEMA)


def test_top_per_profile_equals_single_profile_runs(spark):
    df = random_listings(spark, 400, 5)
    cvs = [(1, CV), (2, "llm rag engineer 9 years of experience"), (3, "cook"), (4, "cook"), (5, "audit sap excel fp&a")]
    profiles = spark.createDataFrame(cvs, "profile_id long, text string")
    got = {}
    for r in top_per_profile(df, profiles, SCORE_RULES, as_of(), 7).orderBy("profile_id", "rank").collect():
        got.setdefault(r["profile_id"], []).append((r["ord"], r["score"]))
    for pid, cv in cvs:
        single = score_listings(df, spark.createDataFrame([(cv,)], "text string"), SCORE_RULES, as_of())
        best = [(r["ord"], r["score"]) for r in ranked_top(single, 7).orderBy("rank").collect()]
        assert got[pid] == best


def test_prefix_and_top(spark):
    df = spark.createDataFrame([(i, float(i % 4), "g" if i % 3 else "h") for i in range(40)], "ord long, score double, g string").repartition(5)
    assert sorted(r["ord"] for r in prefix_until(df, 3, 3.0).collect()) == list(range(12))
    assert prefix_until(df, 99, 3.0).count() == 40
    assert [r["ord"] for r in ranked_top(df, 3).orderBy("rank").collect()] == [3, 7, 11]
    assert [r["ord"] for r in top_per_group(df, ["g"], 2).orderBy("g", "rank").collect()] == [7, 11, 3, 15]
    counts = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, None)], "ord long, k string")
    assert [(r["name"], r["n"]) for r in top_groups(counts, "k", 3).collect()] == [("b", 2), ("a", 2), ("Unknown", 1)]


def test_filters(spark):
    df = spark.createDataFrame([("7",), ("x",), (None,), ("5.9",), ("6",)], "score string")
    assert sorted(r[0] for r in at_least(df, 6).collect()) == ["6", "7"]
    days = spark.createDataFrame([("2024-01-09",), ("2024-01-08",)], "d string").select(F.col("d").cast("date").alias("posted"))
    assert recent_only(days, as_of(), 5).count() == 1
    jobs = spark.createDataFrame([("Acme", "Field Sales"), ("B", "C")], "company string, title string")
    kept, rejected = split_rejected(jobs, ["field sales"])
    assert kept.count() == 1 and rejected.first()["rejection_reason"] == "Blacklisted company/keyword match"
    assert constant_scores(kept, 6).first()["score"] == 6.0


def test_filter_on_score_copies_no_text_search(spark):
    """A filter above the score must not repeat the text normalisation below it."""
    df = random_listings(spark, 10, 1)
    scored = score_entries(score_listings(df, spark.createDataFrame([(CV,)], "text string"), SCORE_RULES, as_of()))
    plan = scored.where("score >= 6")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "regexp_replace" in line]


def test_few_signatures_are_compared(spark):
    """Bounds leave out nearly all pairs of a signature and a kind of profile."""
    rnd = random.Random(9)
    terms = [t for words in SCORE_RULES.lexicons.values() for t in words]
    cats = list(SCORE_RULES.lexicons)
    rows = [
        (i, rnd.choice(["Data Analyst", "Engineer", "Cook", "Genai"]), "c", rnd.choice(cats), rnd.choice(["Remote", "a (hybrid)", "b"]),
         rnd.choice(["2024-01-10", "2024-01-08", "bad"]), " ".join(rnd.sample(terms, rnd.randint(1, 9))) + f" {rnd.randint(1, 9)} years")
        for i in range(3000)
    ]
    listings = spark.createDataFrame(rows, SCHEMA)
    cvs = [(i, " ".join(rnd.sample(terms, 12)) + f" {i % 9} years of experience data analyst") for i in range(12)]
    groups = scoring._signatures(listings, SCORE_RULES, as_of(), 5, "posted", "ord")
    features = scoring.profile_table(spark.createDataFrame(cvs, "kind long, text string"), SCORE_RULES)
    kinds = features.select(
        "kind", F.col("features")["role_values"].alias("role_values"), F.col("features")["years"].alias("years"),
        S.known_masks(F.col("features")["known"], SCORE_RULES).alias("known"),
    )
    joined = scoring.wanted_cells(groups, kinds, SCORE_RULES, 5).join(groups.withColumn("_cell", scoring._cell()), "_cell").count()
    assert joined <= 0.05 * groups.count() * kinds.count()


def test_a_prefix_scores_at_most_twice_its_rows(spark):
    scored = []

    def score(rows):
        out = materialize(rows.withColumn("score", (F.col("ord") % 10).cast("double")), "counted")
        scored.append(out.count())
        return out

    df = spark.range(0, 100_000).select(F.col("id").alias("ord")).repartition(7)
    got = prefix_until_scored(df, score, 40, 9.0)
    assert sorted(r["ord"] for r in got.collect()) == list(range(400)) and sum(scored) <= 2 * 400
    scored.clear()
    assert prefix_until_scored(df.where("ord % 1000 = 9"), score, 400, 9.0).count() == 100
    assert prefix_until_scored(df.limit(0), score, 3, 9.0).count() == 0


def test_shared_texts_score_like_whole_descriptions(spark):
    """Terms and years that reach over the ends of a text, empty, blank and missing texts."""
    rules = ScoreRules(
        roles={"x": ("ab cd", " gizmo"), "y": ("new", "e f")}, lexicons={"k": ("cd ef", "node", "q 5+", "b"), "z": ("e",)}, default_category="z",
    )
    texts = [(0, "CD  ef\tnode 12"), (1, ""), (2, None), (3, "  "), (4, "gizmo 3 years e"), (5, "q"), (6, "0012 years"), (7, "a b c" * 30 + " 7+")]
    titles, notes = ["ab", "", "new e", None], ["5+ years", "years", "", " f\u03a3 4 yrs", None]
    rows, i = [], 0
    for t, text in texts:
        for title in titles:
            for note in notes:
                whole = None if text is None else text + " " + (note or "")
                rows.append((i, t, title, ["k", "z", None][i % 3], "Remote", "2024-01-10", note, whole))
                i += 1
    df = spark.createDataFrame(rows, "ord long, text_id long, title string, category string, location string, posted string, note string, description string")
    bodies = scoring.text_bodies(spark.createDataFrame(texts, "text_id long, text string"), rules)
    shared = df.drop("description").join(bodies, "text_id")
    profile = spark.createDataFrame([("x ab cd new q 5+ node b e cd ef 4 years of experience",)], "text string")
    cols = ["ord", *scoring.SCORE_COLUMNS]
    whole = score_listings(df, profile, rules, as_of()).select(cols).orderBy("ord").collect()
    assert score_listings(shared, profile, rules, as_of(), body="body").select(cols).orderBy("ord").collect() == whole
    many = profile.select(F.lit(1).alias("profile_id"), "text")
    top = lambda rows, **kw: top_per_profile(rows, many, rules, as_of(), 50, **kw).orderBy("rank").collect()
    assert top(shared, body="body") == top(df)


def test_loops_over_terms_search_texts_that_are_made_before(spark):
    """What a loop makes itself is made again for each of its terms."""
    rows = spark.createDataFrame([(0, "Data Analyst", "data_analyst", "Remote", None, 0, "2 years")], "ord long, title string, category string, location string, posted string, text_id long, note string")
    bodies = scoring.text_bodies(spark.createDataFrame([(0, "sql and python")], "text_id long, text string"), SCORE_RULES)
    profile = spark.createDataFrame([("Data Analyst, sql",)], "text string")
    whole = rows.withColumn("description", F.lit("sql and python 2 years"))
    for scored in (
        score_listings(whole, profile, SCORE_RULES, as_of()),
        score_listings(rows.join(bodies, "text_id"), profile, SCORE_RULES, as_of(), body="body"),
    ):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        loops = [line for line in plan.splitlines() if "Generate" in line and "struct(_hits" in line]
        assert len(loops) == 1
        # The lists of terms stand in brackets.
        assert not re.search("regexp|concat|array_join|lower|CASE", re.sub(r"\[\[.*?\]\]", "", loops[0]))
