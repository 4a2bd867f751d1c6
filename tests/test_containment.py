"""Terms in texts by rare anchors, against a plain search, and the rows it makes."""

import itertools
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listingflow.operators import containment
from listingflow.operators.filters import flag_by_table


def brute(texts, terms):
    return {(t, w) for t in texts for w in terms if w and t is not None and w in t}


def found(spark, texts, terms):
    t = containment.numbered(spark.createDataFrame([(x,) for x in texts], "text string"))
    pairs = containment.contained(t, spark.createDataFrame([(w,) for w in terms], "term string"))
    return {(r["text"], r["term"]) for r in pairs.join(t, "text_id").select("text", "term").collect()}


LETTERS = st.text(alphabet="abé🙂 \n%_", max_size=7)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé🙂 \n%_", max_size=30), min_size=1, max_size=8), st.lists(LETTERS, min_size=1, max_size=8))
def test_contained_equals_a_plain_search(spark, texts, terms):
    assert found(spark, texts, terms) == brute(texts, terms)


def test_nulls_long_texts_and_empty_tables(spark):
    long = "x" * 30_000 + "needle" + "🙂" * 10 + "end"
    texts, terms = [None, "", long, "ab", "b"], [None, "", "needle", "x" * 40, "🙂end", "b", "ab", "abc", "zzz"]
    assert found(spark, texts, terms) == brute(texts, [t for t in terms if t])
    none = spark.createDataFrame([], "text string")
    assert containment.contained(containment.numbered(none), spark.createDataFrame([("a",)], "term string")).count() == 0
    some = containment.numbered(spark.createDataFrame([("a",)], "text string"))
    assert containment.contained(some, spark.createDataFrame([], "term string")).count() == 0


def test_rows_are_about_as_many_as_characters(spark):
    """Whatever the lengths of the terms, a text gives a row for each of its places and one
    for each of its different short runs; candidates stem from rare runs alone."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(200)) for _ in range(100)]
    terms = [t[i : i + n] for t in texts[:40] for i, n in ((3, 1), (9, 2), (20, 5), (50, 17), (100, 60))]
    table = containment.numbered(spark.createDataFrame([(x,) for x in texts], "text string"))
    rows = containment.grams(table, F.array(F.lit(1), F.lit(2), F.lit(3)))
    chars = sum(map(len, texts))
    assert rows.where("length(gram) = 3").count() == chars - 2 * len(texts)
    assert rows.count() <= 1.7 * chars
    wanted = spark.createDataFrame([(w,) for w in terms if len(w) > 3], "term string").distinct()
    near = rows.join(containment.anchors(wanted, rows), "gram").where("place >= offset")
    # Twenty thousand characters and 120 terms, but few places to look at for each term.
    assert near.count() <= 20 * wanted.count()


def test_a_hot_text_is_searched_once(spark):
    rows = [(i, "Acme Widgets" if i % 3 else f"Firm {i}", "Ring" if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, company string, title string")
    terms = spark.createDataFrame([(" WIDGET ",), ("firm 3",), ("",), (None,)], "term string")
    got = {r["ord"] for r in flag_by_table(df, terms).where("rejection_reason is not null").collect()}
    assert got == {i for i, c, _ in rows if "widget" in c.lower() or "firm 3" in c.lower()}


def test_runs_of_texts_are_never_broadcast(spark):
    """By the file of the texts they would look small enough to be, and fill the driver."""
    texts = containment.numbered(spark.createDataFrame([(f"some text {i}",) for i in range(50)], "text string"))
    terms = spark.createDataFrame([("text 1",), ("me",)], "term string")
    lines = containment.contained(texts, terms)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    sent = [
        inner for i, line in enumerate(lines) if "BroadcastExchange" in line
        for inner in itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])
    ]
    assert any("Generate" in line for line in lines) and not any("Generate inline" in line or "text#" in line for line in sent)
