import datetime as dt
import random

import pytest

from stationlake.model import SOURCES, raw_schema
from stationlake.plans import marts
from stationlake.plans.refresh import read_mart, refresh
from stationlake.session import work_path
from stationlake.sources import tables as tb
from stationlake.sources import versions
from tests.helpers import hours, rows
from workload.registry import rounded

ORDER = {
    "hourly": ["city", "time_utc"], "daily": ["city", "date_local"], "weekly": ["city", "iso_year", "iso_week"],
    "seasons": ["city", "pollen_type", "year"], "missing_values": ["source", "city", "year", "variable"],
}


def raw(spark, source, listed, at):
    names = SOURCES[source]
    full = [(c, t, *[v if i < 5 else None for i in range(len(names))], dt.datetime(2025, 1, at)) for c, t, v in listed]
    return spark.createDataFrame(full, raw_schema(names))


def rebuilt(air, weather, min_hours):
    hourly = marts.hourly(marts.stage_air_quality(air), marts.stage_weather(weather))
    daily = marts.daily(hourly, min_hours)
    return {
        "hourly": hourly, "daily": daily, "weekly": marts.weekly(daily), "seasons": marts.seasons(daily),
        "missing_values": marts.missing_values({"air_quality": air, "weather": weather}),
    }


@pytest.mark.parametrize("seed", range(1))
def test_loads_in_any_order_equal_a_rebuild(spark, seed):
    """Random parts with corrections, around a change of year and of clocks, in any order of times."""
    rng = random.Random(seed)
    folder = work_path(spark, "marts")
    span = hours("2023-12-20", 24 * 24) + hours("2024-03-28", 24 * 6)
    air, weather = {}, {}
    for load in range(1, 4):
        parts = [(c, t, float(rng.randrange(0, 64, 4))) for c in ("a", "b") for t in rng.sample(span, 300)]
        sky = [(c, t, float(rng.randrange(0, 64, 4))) for c in ("a", "b", "c") for t in rng.sample(span, 100)]
        has_sky, has_air = load != 2, load != 3
        refresh(
            spark, folder, raw(spark, "air_quality", parts, load) if has_air else None,
            raw(spark, "weather", sky, load) if has_sky else None, min_hours=8, keep=9,
        )
        if has_air:
            air |= {(c, t): (c, t, v) for c, t, v in parts}
        if has_sky:
            weather |= {(c, t): (c, t, v) for c, t, v in sky}
    whole = rebuilt(raw(spark, "air_quality", air.values(), 1), raw(spark, "weather", weather.values(), 1), 8)
    for name in tb.MARTS:
        got = read_mart(spark, folder, name)
        assert got.columns == whole[name].columns
        assert rows(rounded(got), *ORDER[name]) == rows(rounded(whole[name]), *ORDER[name]), name


def test_a_load_leaves_other_periods_alone_and_can_be_repeated(spark):
    folder = work_path(spark, "marts")
    first = raw(spark, "air_quality", [("a", t, 4.0) for t in hours("2022-05-01", 24 * 70)], 1)
    refresh(spark, folder, first)
    later = raw(spark, "air_quality", [("a", t, 8.0) for t in hours("2022-07-05", 24 * 3)], 2)
    before = {n: versions.version(spark, f"{folder}/{n}") for n in tb.MARTS}
    refresh(spark, folder, later)
    once = {n: rows(read_mart(spark, folder, n), *ORDER[n]) for n in tb.MARTS}
    for name in ("hourly", "daily"):
        after = versions.version(spark, f"{folder}/{name}")
        kept = {p for p, v in after.periods.items() if before[name].periods.get(p) == v}
        assert kept and "202207" not in kept and {"202205", "202206"} <= kept
    refresh(spark, folder, later)
    assert {n: rows(read_mart(spark, folder, n), *ORDER[n]) for n in tb.MARTS} == once
    assert {r[-2] for r in once["seasons"]} == {8.0}


def test_new_columns_are_counted_for_all_years(spark):
    folder = work_path(spark, "marts")
    refresh(spark, folder, raw(spark, "air_quality", [("a", dt.datetime(2021, 5, 1), 1.0)], 1))
    one = raw(spark, "air_quality", [("a", dt.datetime(2023, 5, 1), 1.0)], 2).selectExpr("*", "1.0D AS olive")
    refresh(spark, folder, one)
    olive = read_mart(spark, folder, "missing_values").filter("variable = 'olive'").select("year", "n_missing")
    assert rows(olive, "year") == [(2021, 1), (2023, 0)]


def test_empty_loads_and_days_below_the_hours_asked_for(spark):
    folder = work_path(spark, "marts")
    refresh(spark, folder, raw(spark, "air_quality", [], 1), raw(spark, "weather", [], 1))
    assert all(read_mart(spark, folder, n).count() == 0 for n in tb.MARTS)
    refresh(spark, folder, raw(spark, "air_quality", [("a", t, 1.0) for t in hours("2022-05-01T22:00", 10)], 1))
    assert read_mart(spark, folder, "hourly").count() == 10 and read_mart(spark, folder, "daily").count() == 0
    refresh(spark, folder, raw(spark, "air_quality", [("a", t, 1.0) for t in hours("2022-05-02T08:00", 14)], 1))
    assert rows(read_mart(spark, folder, "daily").select("date_local", "n_hours")) == [(dt.date(2022, 5, 2), 24)]
