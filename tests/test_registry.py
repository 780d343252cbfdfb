"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return check.database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    assert check.compare(spark, database, SF, name).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
