"""Every registered job against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_job_matches_oracle(spark, con, name):
    assert compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF, verbose=True)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns
