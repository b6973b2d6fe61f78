"""Every registered query runs at the smallest scale and equals its SQL."""

import pytest

from pitpanel import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


SLOW = {"ts6_classifier_trees"}  # run by tests/oracle.py


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    status, _, _, _, detail = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert status in ("ok", "rows-only"), detail
