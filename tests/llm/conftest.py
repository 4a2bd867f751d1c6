"""Small frames and helpers for the corpus operators."""

import pytest

from listingflow.llm.ship import ship

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """A table of the smallest test data, by name."""
    ship(spark)
    return lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """A frame from rows and a schema; an empty list gives an empty table."""
    ship(spark)
    return lambda rows, schema: spark.createDataFrame(rows, schema)
