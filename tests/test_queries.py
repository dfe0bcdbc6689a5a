"""Every query of the library's own operators against its SQL, on the smallest tables."""

import os

import pytest

from tidemark.catalogue import ORACLES, QUERIES

from .oracle import database, of_spark, of_sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(db, ORACLES[name])


def test_registry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
