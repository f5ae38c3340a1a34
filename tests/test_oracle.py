"""Every registered query against its SQL text on the smallest data folder."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from tidemark.plans.catalog import all_queries
from tidemark.plans.oracle import ORACLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    assert difference(entry.queries()[name](spark, FOLDER), connection, entry.oracle_sql()[name]) is None
