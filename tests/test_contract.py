"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from compare import compare, duck
from workload import all_queries, all_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# Checked against brute force or invariants in this folder instead of SQL.
WITHOUT_SQL = {"closest_record_lineitem", "closest_record_approximate"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_or_a_reason():
    assert set(all_queries()) - set(all_sql()) == WITHOUT_SQL
    assert set(all_queries()) <= set(contract.queries()) and set(all_sql()) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    message, rows, _ = compare(spark, con, name, contract.queries()[name], contract.oracle_sql().get(name), SF)
    assert message is None
    assert rows > 0
