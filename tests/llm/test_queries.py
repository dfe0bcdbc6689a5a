"""The registered queries against their SQL, on the smallest tables."""

import os

import pytest

from tests.oracle import database, of_spark, of_sql
from tidemark.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_sql(db, ORACLES[name])
