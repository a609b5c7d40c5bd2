import datetime as dt

import pytest
from pyspark.sql import functions as F

from stationlake.functions import calendar as cal
from stationlake.functions import conditions as cond
from stationlake.model import RAIN_BINS


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def day(text):
    return F.lit(dt.date.fromisoformat(text))


@pytest.mark.parametrize(
    "utc,local",
    [
        ("2024-03-31 00:30:00", "2024-03-31 01:30:00"),
        ("2024-03-31 01:00:00", "2024-03-31 03:00:00"),
        ("2024-10-27 00:00:00", "2024-10-27 02:00:00"),
        ("2024-10-27 01:00:00", "2024-10-27 02:00:00"),
        ("2024-01-01 23:30:00", "2024-01-02 00:30:00"),
    ],
)
@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_local_time(spark, utc, local, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        assert one(spark, cal.local_time(ntz(utc))) == dt.datetime.fromisoformat(local)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("utc,text", [("2026-07-07 11:34", "13:30"), ("2026-01-07 11:34", "12:30")])
def test_publication_time_does_not_depend_on_the_session(spark, zone, utc, text):
    epoch = int(dt.datetime.fromisoformat(utc).replace(tzinfo=dt.timezone.utc).timestamp())
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, cal.publication_time(F.lit(epoch))) == text
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("last,expected", [("2026-10-07", 0), ("2026-10-05", 2), ("2026-10-08", 0)])
def test_days_behind(spark, last, expected):
    assert one(spark, cal.days_behind(day(last), day("2026-10-08"))) == expected


@pytest.mark.parametrize(
    "text,year,week",
    [("2021-01-03", 2020, 53), ("2021-01-04", 2021, 1), ("2024-12-30", 2025, 1), ("2026-12-31", 2026, 53)],
)
def test_iso_week_edges(spark, text, year, week):
    assert one(spark, cal.iso_year(day(text))) == year
    assert one(spark, cal.iso_week(day(text))) == week


@pytest.mark.parametrize("doy,expected", [(59.5, "2023-03-01"), (60.5, "2023-03-01"), (61.5, "2023-03-03"), (1.0, "2023-01-01")])
def test_day_of_year_rounds_half_to_even(spark, doy, expected):
    assert one(spark, cal.doy_to_date(F.lit(doy), 2023)) == dt.date.fromisoformat(expected)


def test_shift_years_clamps_leap_day(spark):
    assert one(spark, cal.shift_years(day("2024-02-29"), -1)) == dt.date(2023, 2, 28)
    assert one(spark, cal.shift_years(day("2024-02-29"), 4)) == dt.date(2028, 2, 29)


def test_half_months(spark):
    assert one(spark, cal.half_month(day("2024-04-15"))) == "Apr 1–15"
    assert one(spark, cal.half_month(day("2024-04-16"))) == "Apr 16–end"


def test_leap_year_calendar(spark):
    assert one(spark, cal.on_leap_year(day("2024-02-29"))) == dt.date(2000, 2, 29)


def test_hour_span_counts_boundaries(spark):
    span = cal.epoch_hours(ntz("2024-01-01 02:01:00")) - cal.epoch_hours(ntz("2024-01-01 00:59:00"))
    assert one(spark, span) == 2


@pytest.mark.parametrize(
    "value,label", [(0.0, "Dry"), (0.1, "Dry"), (0.11, "Light rain"), (2.0, "Light rain"), (2.01, "Rainy"), (2000.0, None), (-1.0, None), (None, None)]
)
def test_bins_are_right_closed(spark, value, label):
    column = cond.right_closed_bin(F.lit(value).cast("double"), *RAIN_BINS)
    assert one(spark, column) == label


def test_unknown_is_not_above(spark):
    df = spark.createDataFrame([(None, 5.0), (11.0, None), (10.0, 10.0)], "a double, b double")
    got = [r.f for r in df.select(cond.any_above({"a": "a", "b": "b"}, 10.0).alias("f")).collect()]
    assert got == [False, True, False]
