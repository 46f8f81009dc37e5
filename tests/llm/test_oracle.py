"""Queries of the corpus operators against their SQL statements on the smallest tables."""

import pytest

from checks.compare import compare
from inkveil.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duckdb_con, name):
    r = compare(spark, duckdb_con, name, QUERIES[name], ORACLES[name], SMALL)
    assert r["ok"], r


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
