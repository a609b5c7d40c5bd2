"""The stand-in tables: how often the lines are read and moved."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA
from workload import fixtures, mart_queries

SF = str(DATA / "sf0.001")


def shuffles_of_lines(df) -> int:
    """Exchanges between the scan of the line items and the result."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan parquet [l_" in line)
    found, above = 0, depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < above:
            above = depth[i]
            found += "Exchange hashpartitioning" in lines[i]
    return found


@pytest.mark.parametrize("name", ["obs_daily", "raw_air", "raw_weather"])
def test_lines_are_moved_once_for_all_joins(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # One for the joins, one for the sums.
        assert shuffles_of_lines(getattr(fixtures, name)(spark, SF)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["season_drivers", "spearman_by_species", "dq_suite", "event_factors_pooled"])
def test_tables_used_more_than_once_are_stored(spark, name):
    text = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    allowed = {"event_factors_pooled": 2}.get(name, 0)
    assert text.count("FileScan parquet [l_") <= allowed


def test_both_loads_read_stored_rows(spark, monkeypatch):
    batches = []
    monkeypatch.setattr(mart_queries, "refresh", lambda s, folder, *loads, **_: batches.extend(loads))
    monkeypatch.setattr(mart_queries, "read_mart", lambda *_: None)
    monkeypatch.setattr(mart_queries.tb, "export_snapshot", lambda *_: None)
    mart_queries.loaded_twice(spark, SF)
    assert len(batches) == 4
    assert not [f for b in batches for f in b.inputFiles() if "lineitem" in f]
