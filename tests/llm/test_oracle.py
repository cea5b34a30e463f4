"""Operators that SQL can express equal their DuckDB statement."""

import pytest

import __spark_entry__ as entry
from mercato.llm.queries import ORACLE_SQL, QUERIES
from tests.parity import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(spark, sf_dir, name):
    problems, rows = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name])
    assert not problems and rows, problems


def test_every_operator_is_registered_once():
    for n in range(1, 14):
        assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in entry.queries()
