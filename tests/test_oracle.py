"""Every registered query against its SQL, over the whole small tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_only_queries_of_the_subpackage_lack_sql():
    assert all(QUERIES[n].__module__.startswith(("listingflow.llm", "corpus_pipeline")) for n in QUERIES if n not in ORACLES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    mine = table(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == table(columns, result.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["rank", "ord", "title", "company", "score", "reason"]
    scores = [r["score"] for r in df.orderBy("rank").collect()]
    assert scores and scores == sorted(scores, reverse=True)
