"""Every registered query against its SQL, on the smallest test data."""

import os

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SMALL = {"search_plays_fourth_down_week"}  # matches no row at the smallest scale


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def own_queries():
    """The queries of this library's tables; those over text corpora are tested beside their operators."""
    return sorted(set(entry_module.queries()) - set(entry_module._corpus_operators()[0]))


def test_every_query_has_sql():
    assert set(own_queries()) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", own_queries())
def test_query_equals_sql(spark, connection, name):
    problem = compare(spark, connection, SF, name)
    assert not problem or (problem == "no rows" and name in SMALL and SF.endswith("sf0.001"))
