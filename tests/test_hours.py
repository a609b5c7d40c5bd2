import datetime as dt

import pytest

from stationlake.plans import hours as hr
from tests.helpers import days, hours, rows

D = dt.date
POLLEN = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen"]
SCHEMA = "city string, time_local timestamp_ntz, date_local date, " + ", ".join(f"{c} double" for c in POLLEN)


def hourly(spark, spans, city="a"):
    """Hours with birch = the calendar year's last digit."""
    listed = [
        (city, t, t.date(), 0.0, float(t.year % 10), 0.0, 0.0)
        for start, n in spans
        for t in hours(start, n)
    ]
    return spark.createDataFrame(listed, SCHEMA)


def day_table(spark, first, last):
    n = (last - first).days + 1
    return spark.createDataFrame([("a", d) for d in days(str(first), n)], "city string, date_local date")


def snapshot(spark, first, n, city="a"):
    listed = [(city, dt.datetime.fromisoformat(first), t, 0.0, 20.0, 0.0, 0.0) for t in hours(first, n)]
    return spark.createDataFrame(
        listed, "city string, current_time timestamp_ntz, time timestamp_ntz, " + ", ".join(f"{c} double" for c in POLLEN)
    )


def test_window_is_half_open_and_knows_its_sites(spark):
    df = hourly(spark, [("2024-05-01", 72)])
    got = hr.hour_window(df, D(2024, 5, 1), D(2024, 5, 2))
    assert got.count() == 24
    other = spark.createDataFrame([("b",)], "city string")
    assert hr.hour_window(df, D(2024, 5, 1), D(2024, 5, 2), sites=other).count() == 0
    assert hr.hour_window(df, D(2024, 5, 1), D(2024, 5, 2), site="b").count() == 0


def test_typical_window_averages_covered_years(spark):
    spans = [(f"{y}-02-20", 24 * 20) for y in (2022, 2023, 2024, 2025)]
    df = hourly(spark, spans)
    table = day_table(spark, D(2022, 2, 27), D(2025, 3, 2))
    got = hr.typical_window(df, table, D(2028, 2, 27), D(2028, 3, 4))
    listed = rows(got.select("time", "birch_pollen", "years"), "time")
    # 2025 ends before the window does; 2023 and 2022 have no 29 February.
    assert listed[0] == (dt.datetime(2028, 2, 27), 3.0, [2022, 2023, 2024])
    # A year's hours keep their distance from its own first day.
    assert listed[-1] == (dt.datetime(2028, 3, 3, 23), 4.0, [2024])
    assert len(listed) == 6 * 24


def test_window_over_new_year(spark):
    df = hourly(spark, [("2022-12-25", 24 * 20), ("2023-12-25", 24 * 20)])
    table = day_table(spark, D(2022, 12, 1), D(2024, 2, 1))
    got = hr.typical_window(df, table, D(2029, 12, 30), D(2030, 1, 2))
    listed = rows(got.select("time", "birch_pollen", "years"), "time")
    assert len(listed) == 72 and listed[0] == (dt.datetime(2029, 12, 30), 2.5, [2022, 2023])


@pytest.mark.parametrize(
    "day,kind,n",
    [
        (D(2024, 5, 8), "live", 96),
        (D(2024, 5, 2), "history", 7 * 24),
        (D(2024, 5, 7), "recent", 96),
        (D(2024, 5, 9), "forecast", 96),
        (D(2030, 5, 3), "typical", 7 * 24),
    ],
)
def test_best_source(spark, day, kind, n):
    df = hourly(spark, [("2024-04-20", 24 * 17)])
    table = day_table(spark, D(2024, 4, 20), D(2024, 5, 6))
    fc = snapshot(spark, "2024-05-06T00:00", 96)
    got = hr.best_source(df, table, fc, day, today=D(2024, 5, 8))
    if kind == "typical":
        got = hr.best_source(df, day_table(spark, D(2024, 4, 20), D(2024, 5, 8)), fc, day, today=D(2024, 5, 8))
    counts = {r.kind: r["count"] for r in got.groupBy("kind").count().collect()}
    expected = n if kind != "typical" else 6 * 24
    assert counts == {kind: expected}


def test_no_snapshot_today_gives_no_rows(spark):
    df = hourly(spark, [("2024-05-01", 48)])
    fc = snapshot(spark, "2024-05-06T00:00", 1).limit(0)
    assert hr.best_source(df, day_table(spark, D(2024, 5, 1), D(2024, 5, 2)), fc, D(2024, 5, 8), D(2024, 5, 8)).count() == 0


@pytest.mark.parametrize(
    "values,expected",
    [
        ([(0.0, 0.0)], (None, None, None, "none")),
        ([(None, None)], (None, None, None, "none")),
        ([(0.1, 0.2), (0.0, 0.9)], ("Birch", 0.9, None, "trace")),
        ([(5.0, 1.0), (7.0, 7.0), (7.0, 2.0)], ("Alder", 7.0, 1, "present")),
        ([(5.0, 101.0), (7.0, 140.0)], ("Birch", 140.0, 1, "high")),
    ],
)
def test_day_summary(spark, values, expected):
    listed = [("a", t, a, b, None, 0.0) for t, (a, b) in zip(hours("2024-05-01", len(values)), values)]
    df = spark.createDataFrame(listed, "city string, time timestamp_ntz, " + ", ".join(f"{c} double" for c in POLLEN))
    assert tuple(hr.day_summary(df, D(2024, 5, 1)).first())[1:] == expected
