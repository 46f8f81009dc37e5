"""Every query against its SQL statement on the smallest tables."""

import pytest

from checks.compare import compare
from checks.oracle import build
from inkveil.plans.catalog import QUERIES
from tests.conftest import SMALL

ORACLE = build()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duckdb_con, name):
    r = compare(spark, duckdb_con, name, QUERIES[name], ORACLE[name], SMALL)
    assert r["ok"], r
