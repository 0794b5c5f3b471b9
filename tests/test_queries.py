"""Every query against its DuckDB statement; a query without rows fails."""

import os

import pytest

from tests.oracle import connect, differences
from tracemill import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_oracle(spark, con, name):
    assert differences(plans.QUERIES[name](spark, SF), con, plans.ORACLE_SQL[name]) == ""


def test_all_have_an_oracle():
    assert set(plans.QUERIES) == set(plans.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
