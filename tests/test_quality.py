import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationlake.plans import profiles as pr
from stationlake.plans import quality as qu
from tests.helpers import hours, rows


def test_rules_return_the_violations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", None), (None, 99.0)], "k string, v double")
    assert rows(qu.unique_combination(df, ["k"])) == [("a", 2)]
    assert [r.v for r in qu.in_range(df, "v", 0, 50).orderBy("v").collect()] == [-1.0, 99.0]
    assert [r.v for r in qu.not_negative(df, "v").collect()] == [-1.0]
    assert qu.not_null(df, "v").count() == 1
    assert [r.k for r in qu.accepted_values(df, "k", ["a"]).collect()] == ["b"]


def test_missing_days_and_hours(spark):
    days = spark.createDataFrame(
        [("a", dt.date(2024, 5, d)) for d in (1, 2, 5)] + [("b", dt.date(2024, 5, 1))], "city string, date_local date"
    )
    assert rows(qu.missing_days(days), "date_local") == [("a", dt.date(2024, 5, 3)), ("a", dt.date(2024, 5, 4))]
    ts = hours("2024-05-01", 5)
    table = spark.createDataFrame([("a", t) for t in ts if t.hour != 2] + [("b", t) for t in ts], "city string, time_utc timestamp_ntz")
    assert rows(qu.missing_hours(table)) == [("a", 4, 5)]


@pytest.mark.parametrize("age,status", [(1, "pass"), (3, "warn"), (5, "error")])
def test_freshness(spark, age, status):
    now = dt.datetime(2024, 5, 10)
    df = spark.createDataFrame([(now - dt.timedelta(days=age),)], "time timestamp_ntz")
    got = qu.freshness({"s": df, "empty": df.limit(0)}, F.lit(now).cast("timestamp_ntz"))
    assert {r.source: r.status for r in got.collect()} == {"s": status, "empty": "error"}


def test_the_rule_set_has_51_rules():
    rules = qu.rule_sets()
    assert sum(len(r) for r in rules.values()) == 51
    assert len(rules["stg_air_quality"]) == 21 and len(rules["stg_weather"]) == 13


def test_one_pass_for_all_row_rules(spark):
    df = spark.createDataFrame([("a", -1.0), ("x", None)], "k string, v double")
    rules = [qu.null_rule("v"), qu.negative_rule("v"), qu.values_rule("k", ["a"]), qu.KeyRule(("k",))]
    got = {r.rule: r.violations for r in qu.run_rules("t", df, rules).collect()}
    assert got == {"not_null(v)": 1, "not_negative(v)": 1, "accepted_values(k)": 1, "unique(k)": 0}


def test_rules_on_sites_equal_the_plain_forms(spark):
    day = [(c, dt.date(2024, 5, d), 24) for c, d in (("a", 1), ("a", 2), ("a", 5), ("b", 1), ("b", 1), (None, 3), (None, 4))]
    days = spark.createDataFrame([*day, ("z", None, 1)], "city string, date_local date, n_hours int")
    ts = hours("2024-05-01", 5)
    times = spark.createDataFrame([("a", t) for t in ts if t.hour != 2] + [("b", t) for t in ts] + [("c", None), (None, ts[0]), (None, ts[0])], "city string, time_utc timestamp_ntz")
    for df, rule, plain in ((days, qu.days_rule(), qu.missing_days), (times, qu.hours_rule(), qu.missing_hours)):
        key = qu.KeyRule(tuple(df.columns[:2]))
        for part in (df, df.limit(0)):
            out = qu.run_rules("t", part, [key, qu.null_rule("city"), rule])
            got = {r.rule: r.violations for r in out.collect()}
            assert got == {
                rule.name: plain(part).count(),
                key.name: qu.unique_combination(part, key.columns).count(),
                "not_null(city)": part.filter("city IS NULL").count(),
            }
    text = qu.run_rules("t", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), [qu.KeyRule(("event_id",)), qu.null_rule("ts")])
    assert text._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError):
        qu.run_rules("t", days, [qu.days_rule()])


def test_missing_report(spark):
    listed = [("s", "a", "v", 2024, 50.0), ("s", "b", "v", 2024, 25.0), ("s", "a", "w", 2024, 0.0)]
    df = spark.createDataFrame(listed, "source string, city string, variable string, year int, pct_missing double")
    assert rows(qu.missing_report(df)) == [("s", "v", 2024, 37.5)]


def test_profiles(spark):
    listed = [(dt.datetime(2024, 1, 1), None, 1.0), (dt.datetime(2024, 1, 2), 3.0, 2.0), (dt.datetime(2024, 1, 3), 5.0, 9.0)]
    df = spark.createDataFrame(listed, "t timestamp_ntz, a_pollen double, b_pollen double")
    names = pr.matching(df, ".*_pollen")
    assert names == ["a_pollen", "b_pollen"]
    got = {r.column: r for r in pr.column_profile(df, names).collect()}
    assert (got["a_pollen"].q50, got["a_pollen"].n_missing, got["b_pollen"].q50) == (4.0, 1, 2.0)
    firsts = {r.variable: r.first_valid for r in pr.first_valid(df, "t", names).collect()}
    assert firsts == {"a_pollen": dt.datetime(2024, 1, 2), "b_pollen": dt.datetime(2024, 1, 1)}
    assert pr.missing_share(df, [], names).first().a_pollen == 0.33
    exact = pr.describe(df, [], "b_pollen", [0.5])
    assert exact.first().p50 == 2.0
    sketch = pr.describe(df, [], "b_pollen", [0.5], approximate=True)
    assert sketch.first().p50 == 2.0
