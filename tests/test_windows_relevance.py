"""Paging, health streaks, statistics and relevance against plain loops."""

import datetime
import random
import re

from pyspark.sql import functions as F

from listingflow.operators import containment, health, relevance, search, stats
from listingflow.operators.filters import enabled_sources


def test_paging_against_a_loop(spark):
    rnd = random.Random(3)
    rows = []
    for task in range(6):
        for page in range(6):
            for _ in range(rnd.randrange(1, 7)):
                # One task holds most rows.
                for _ in range(30 if task == 0 else 1):
                    rows.append((task, page, len(rows), rnd.choice(["", *map(str, range(40 if task == 0 else 8))])))
    expected = []
    for task in range(6):
        seen = set()
        for page in range(6):
            mine = [r for r in rows if r[0] == task and r[1] == page]
            dups = 0
            for r in mine:
                if r[3] and r[3] in seen:
                    dups += 1
                    continue
                if r[3]:
                    seen.add(r[3])
                expected.append(r[2])
            if page > 0 and dups > 0 and dups / len(mine) >= 0.5:
                break
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "task int, page int, ord long, job_id string")
    assert sorted(r["ord"] for r in search.until_duplicates(df).collect()) == expected


def test_page_of_exactly_half_duplicates_stops_and_page_zero_never(spark):
    rows = [(0, 0, 0, "a"), (0, 0, 1, "a"), (0, 1, 2, "a"), (0, 1, 3, "b"), (0, 2, 4, "c")]
    df = spark.createDataFrame(rows, "task int, page int, ord long, job_id string")
    assert sorted(r["ord"] for r in search.until_duplicates(df).collect()) == [0, 3]


def test_empty_page_and_limit(spark):
    df = spark.createDataFrame([(0, 0, 3), (0, 1, 0), (0, 2, 4), (1, 0, 1), (1, 1, None)], "task int, page int, rows int")
    assert sorted((r["task"], r["page"]) for r in search.before_empty_page(df).collect()) == [(0, 0), (1, 0)]
    assert search.page_limit(df, 1).count() == 2


def test_task_grid_and_modes(spark):
    variants = search.location_variants(["P", "Q", "R", "S"])
    assert len(variants) == 9 and variants[5] == ("P (Hybrid)", "hybrid")
    grid = search.task_grid(spark.createDataFrame([(0, "a"), (1, "b")], "keyword_ord long, keyword string"), variants)
    assert [r["task_ord"] for r in grid.orderBy("task_ord").collect()] == list(range(18))
    df = spark.createDataFrame([("x", "remote"), ("x (hybrid)", "hybrid"), ("x", "hybrid"), ("x", "wfh"), ("x", "onsite")], "l string, m string")
    got = [r[0] for r in df.select(search.mode_location("l", "m", F.lit("P (Hybrid)"))).collect()]
    assert got == ["Remote", "x (hybrid)", "P (Hybrid)", "Work From Home", "x"]


def test_streaks_reach_over_blocks(spark):
    rnd = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    rows, expected = [], {}
    for source in ("hot", "b", "c"):
        streak = 0
        for i in range(400 if source == "hot" else 60):
            found = 0 if rnd.random() < (0.97 if source == "hot" else 0.6) else 5
            ts = start + datetime.timedelta(minutes=37 * i)
            streak = streak + 1 if found == 0 else 0
            rows.append((source, ts, found))
            expected[(source, ts)] = (streak, streak < 3)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, run_ts timestamp_ntz, jobs_found long")
    out = health.zero_streaks(df, block_seconds=3600 * 5)
    got = {(r["source"], r["run_ts"]): (r["consecutive_zero"], r["healthy"]) for r in out.collect()}
    assert got == expected
    last = {r["source"]: r["consecutive_zero"] for r in health.current_health(out).collect()}
    assert last["b"] == expected[("b", start + datetime.timedelta(minutes=37 * 59))][0]


def test_statistics(spark):
    log = spark.createDataFrame(
        [("a", 1, 10, 2, False, False, 1.0), ("a", 1, 5, 5, True, True, 2.0), ("b", 2, None, None, False, False, None)],
        "source string, task int, rows int, dups int, failed boolean, early_stopped boolean, duration double",
    )
    # A failed fetch is no page read; the duration of a search is that of all pages of its task.
    got = {r["source"]: r for r in stats.fetch_stats(log).collect()}
    assert (got["a"]["queries"], got["a"]["pages_scraped"], got["a"]["jobs_found"], got["a"]["avg_duration"]) == (1, 1, 8, 3.0)
    assert (got["b"]["jobs_found"], got["b"]["avg_duration"], got["b"]["total_duration"]) == (0, 0.0, 0.0)
    phases = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 1.0)], "phase string, seconds double")
    assert {r["phase"]: r["percent"] for r in stats.phase_share(phases).collect()} == {"x": 75.0, "y": 25.0}
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert enabled_sources(df, {"a": False, "b": True}).count() == 2


def brute_rank(docs, projects, k):
    out = {}
    for doc, text in docs:
        low = (text or "").lower()
        scored = []
        for order, project in projects:
            words = set(re.findall(r"[a-zA-Z][a-zA-Z0-9+#.]*", (project or "").lower()))
            scored.append((-sum(1 for w in words if w in low), order))
        out[doc] = [(order, -minus) for minus, order in sorted(scored)[:k]]
    return out


def test_relevance_equals_a_plain_search(spark):
    rnd = random.Random(4)
    words = ["c++", "node.js", "ab", "abc", "r", "storage", "rag", "x1", "é", "Zed", "q#", "3d"]
    # A third of the documents are the same text; two have none.
    docs = [(i, "storage abc node.js!" if i % 3 == 0 else " ".join(rnd.choices(words, k=6))) for i in range(60)] + [(98, ""), (99, None)]
    projects = [(i, " ".join(rnd.choices(words, k=4))) for i in range(11)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(projects, "project_ord long, project_text string")
    for k in (1, 4, 20):
        expected = brute_rank(docs, projects, k)
        got = {}
        for r in relevance.rank_projects(d, p, k).orderBy("doc_id", "rank").collect():
            got.setdefault(r["doc_id"], []).append((r["project"], r["relevance"]))
        assert got == expected


def test_tokens_that_begin_with_each_other_are_all_found():
    tokens = ["a", "ab", "abc", "abcdefghijklm", "abcdefghijkxy", "b", "c++", "c+", "node.js"]
    found = re.findall(relevance.longest_at(tokens), "xabcdefghijkxy c+++ nodexjs node.js")
    assert found == ["abcdefghijkxy", "b", "c++", "node.js"]


def test_found_tokens_in_pieces_and_of_repeated_documents(spark, monkeypatch):
    """Rows of one id are one document, also where the id is missing, whatever the number of patterns."""
    docs = [(1, "Alpha beta"), (1, "betas gamma"), (1, "Alpha beta"), (None, "delta"), (None, "xalphax"), (2, None), (3, "nothing")]
    projects = [(0, "alpha beta gamma"), (1, "beta bet be"), (2, "delta alpha"), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    p = spark.createDataFrame(projects, "project_ord long, project_text string")
    joined = [(i, "\n".join(t or "" for j, t in docs if i == j)) for i in (1, None, 2, 3)]
    for piece in (relevance.PIECE, 2):
        monkeypatch.setattr(relevance, "PIECE", piece)
        got = {}
        for r in relevance.rank_projects(d, p, 2).orderBy("doc_id", "rank").collect():
            got.setdefault(r["doc_id"], []).append((r["project"], r["relevance"]))
        assert got == brute_rank(joined, projects, 2)


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name == "ReusedExchangeExec":
        return 0
    if name.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    metric, children = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    return (metric.get().value() if metric.isDefined() else 0) + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_no_row_for_each_word_or_project_is_shuffled(spark, monkeypatch):
    """A few rows of each document are, and they are all the disk that the ranking takes."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    docs = [(i, " ".join(rnd.choices(words, k=120))) for i in range(300)]
    projects = [(i, " ".join(rnd.choices(words, k=12))) for i in range(60)]
    rows = []

    def written(df, label):
        kept = df.collect()
        rows.append(shuffled_rows(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(kept, df.schema)

    monkeypatch.setattr(relevance, "materialize", written)
    monkeypatch.setattr(containment, "materialize", written)
    ranked = relevance.rank_projects(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(projects, "project_ord long, project_text string"), 3)
    got = {}
    for r in sorted(ranked.collect()):
        got.setdefault(r["doc_id"], []).append((r["project"], r["relevance"]))
    rows.append(shuffled_rows(ranked._jdf.queryExecution().executedPlan()))
    assert got == brute_rank(docs, projects, 3)
    # Documents have more than a hundred words and meet nearly all sixty projects.
    assert sum(rows) < 20 * len(docs) + 5 * 12 * len(projects)


def test_requests(spark):
    df = spark.createDataFrame([("A", None)], "title string, d string")
    assert relevance.requests(df, "T={title};{d}!", {"title": "title", "d": "d"}).first()["request"] == "T=A;!"
