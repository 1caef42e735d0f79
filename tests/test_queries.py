"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR, con)
    assert problem is None, problem


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "enterprise_name", "associated_count"]
    assert df.count() > 0
