"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect
from coordloom.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    """Queries of the llm subpackage have their own tests."""
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = queries()[name](spark, SF_DIR).toPandas()
    assert compare(got, con.execute(oracle_sql()[name]).df()) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
