"""Every registered query with SQL must give the same rows in DuckDB."""

import pytest

from tests.oracle import compare, connect
from trackframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) in ("", "no rows")
