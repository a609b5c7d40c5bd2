"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, connect
from workload.registry import CHECKS, QUERIES

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    if name in CHECKS:
        assert compare(spark, con, name, QUERIES[name], CHECKS[name], SF) == []
    else:
        QUERIES[name](spark, str(DATA / SF)).collect()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
