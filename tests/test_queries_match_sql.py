"""Every registered query with a SQL equivalent gives the same rows in DuckDB."""

import pytest

from tools.compare import connect, differences
from workload import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, duck, name):
    assert differences(QUERIES[name](spark, small), duck.sql(ORACLES[name])) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, small, name):
    assert not QUERIES[name](spark, small).isEmpty()
