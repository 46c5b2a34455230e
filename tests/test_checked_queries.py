"""Every checked query equals its SQL twin on the smallest given tables."""

import pytest

from evisift_checks.compare import compare, connect
from evisift_checks.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_twin(spark, con, name):
    told = compare(spark, con, name, SMALL)
    assert ": ok" in told, told


def test_entry_runs(spark):
    import __spark_entry__ as driver

    rows = driver.entry(spark).collect()
    assert len(rows) == 200
    assert len(rows[0]) == 16
