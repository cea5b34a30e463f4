"""Every registered query equals its DuckDB oracle on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from tests.parity import compare, duck

QUERIES = {name: entry.queries()[name] for name in entry.REPORTS}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, sf_dir, con, name):
    problems, _ = compare(QUERIES[name](spark, sf_dir), con, ORACLE[name])
    assert not problems, problems


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
