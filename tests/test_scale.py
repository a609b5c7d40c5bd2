"""Plan shapes that must hold at any size of the data."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA
from workload.registry import QUERIES

SF = str(DATA / "sf0.001")
STORING = {"upsert_table", "upsert_types", "upsert_versions", "snapshot_roundtrip", "load_landed_files", "rejected_files"}
LAZY = sorted(n for n in QUERIES if n not in STORING and not n.startswith(("stream_", "loaded_")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_auto_broadcast(spark):
    """Only broadcasts asked for by hint remain."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", LAZY)
def test_plan_shape(no_auto_broadcast, name):
    text = plan(entry.queries()[name](no_auto_broadcast, SF))
    for node in (
        "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "CollectLimit"
    ):
        assert node not in text
    assert "BroadcastExchange" not in text
    # Every window has partition keys: rows never all meet in one task to be ordered.
    for line in text.splitlines():
        if re.search(r"[-: ]Window \[", line):
            assert not re.search(r"windowspecdefinition\([^,()]+ (ASC|DESC)", line), line


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(entry.queries()["seasons_5_95"](spark, SF))
    read = re.search(r"FileScan parquet \[(l_[^\]]*)\]", text).group(1)
    assert {c.split("#")[0] for c in read.split(",")} == {
        "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    }


def test_results_do_not_depend_on_broadcasts_or_partitions(spark):
    names = ["rain_event_summary", "combined_risk_days", "spearman_by_species"]
    queries = entry.queries()
    expected = {n: sorted(map(repr, queries[n](spark, SF).collect())) for n in names}
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for n in names:
            assert sorted(map(repr, queries[n](spark, SF).collect())) == expected[n]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
