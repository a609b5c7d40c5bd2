import datetime as dt

import pytest

from stationlake.plans import alerts
from tests.helpers import hours, rows, seasons_table

D = dt.date


def spring(spark):
    """Alder from about 8 March, birch from about 16 April, three years."""
    listed = []
    for year, shift in ((2023, -1), (2024, 0), (2025, 1)):
        leap = 1 if year == 2024 else 0
        for species, start, end in (("alder", 67, 95), ("birch", 106, 140)):
            first = D(year, 1, 1) + dt.timedelta(days=start + shift - 1)
            last = D(year, 1, 1) + dt.timedelta(days=end + shift - 1)
            listed.append(("Stockholm", species, year, first, first, last))
    return seasons_table(spark, listed)


def forecast(spark, birch, start="2026-05-01T10:00", current="2026-05-01T10:00", city="Stockholm"):
    now = dt.datetime.fromisoformat(current)
    listed = [(city, now, t, 0.0, b, 0.0, None) for t, b in zip(hours(start, len(birch)), birch)]
    return spark.createDataFrame(
        listed,
        "city string, current_time timestamp_ntz, time timestamp_ntz, alder_pollen double, "
        "birch_pollen double, grass_pollen double, mugwort_pollen double",
    )


def test_a_season_two_weeks_ahead_is_announced(spark):
    got = alerts.coming_alerts(spring(spark), D(2026, 4, 2)).collect()
    assert [(r.pollen_type, r.days, r.start) for r in got] == [("Birch", 14, D(2026, 4, 16))]
    assert (got[0].earliest, got[0].latest) == (D(2026, 4, 15), D(2026, 4, 17))
    assert (got[0].first_year, got[0].last_year) == (2023, 2025)


@pytest.mark.parametrize("day", [D(2026, 1, 15), D(2026, 4, 1), D(2026, 4, 16), D(2026, 4, 20)])
def test_no_alert_outside_the_lead(spark, day):
    assert alerts.coming_alerts(spring(spark), day).count() == 0


def test_next_season_wraps_to_the_next_year(spark):
    row = alerts.next_season(spring(spark), D(2026, 10, 7)).first()
    assert (row.pollen_type, row.start) == ("Alder", D(2027, 3, 8))
    row = alerts.next_season(spring(spark), D(2026, 3, 8)).first()
    assert (row.pollen_type, row.start) == ("Birch", D(2026, 4, 16))
    row = alerts.next_season_doy(spring(spark), D(2026, 10, 7)).first()
    assert (row.pollen_type, row.start_doy) == ("Alder", 67.0)


@pytest.mark.parametrize(
    "day,status", [(D(2026, 10, 7), "green"), (D(2027, 2, 25), "yellow"), (D(2026, 5, 1), "red")]
)
def test_traffic_light(spark, day, status):
    seasons = spring(spark)
    found = alerts.check(seasons, day)
    sites = spark.createDataFrame([("Stockholm",), ("Elsewhere",)], "city string")
    got = dict(rows(alerts.site_status(found, alerts.in_typical_season(seasons, day), sites)))
    assert got == {"Stockholm": status, "Elsewhere": "green"}


def test_a_forecast_alone_is_red(spark):
    day = D(2026, 10, 7)
    found = alerts.check(spring(spark), day, forecast(spark, [12.0] * 3), today=day)
    sites = spark.createDataFrame([("Stockholm",)], "city string")
    active = alerts.in_typical_season(spring(spark), day)
    assert alerts.site_status(found, active, sites).first().status == "red"
    assert rows(alerts.active_species(found, active)) == [("Stockholm", "Birch")]


def test_the_forecast_counts_only_today(spark):
    found = alerts.check(spring(spark), D(2026, 4, 2), forecast(spark, [12.0] * 3), today=D(2026, 10, 7))
    assert [r.kind for r in found.collect()] == ["coming"]


def test_three_hours_in_a_row(spark):
    got = alerts.forecast_alerts(forecast(spark, [2.0, 12.0, 15.0, 18.0, 20.0])).collect()
    assert [(r.pollen_type, r.from_time, r.peak) for r in got] == [
        ("Birch", dt.datetime(2026, 5, 1, 11), 20.0)
    ]


@pytest.mark.parametrize(
    "values", [[2.0, 12.0, 15.0, 3.0, 25.0, 1.0], [12.0, 12.0, None, 12.0, 12.0], [12.0, 12.0], [9.9] * 5]
)
def test_a_short_peak_is_no_alert(spark, values):
    assert alerts.forecast_alerts(forecast(spark, values)).count() == 0


def test_hours_before_now_do_not_count(spark):
    past = forecast(spark, [30.0] * 4 + [0.0] * 3, start="2026-05-01T06:00")
    assert alerts.forecast_alerts(past).count() == 0


def test_keys_differ_by_channel_and_are_sent_once(spark):
    keyed = alerts.with_keys(alerts.coming_alerts(spring(spark), D(2026, 4, 2)), ["desktop", "push"])
    keys = sorted(r.alert_key for r in keyed.collect())
    assert keys == ["desktop|Stockholm|Birch|coming|2026", "push|Stockholm|Birch|coming|2026"]
    ledger = spark.createDataFrame([(keys[0],)], "alert_key string")
    again = alerts.unsent(keyed.unionByName(keyed), ledger)
    assert [r.alert_key for r in again.collect()] == keys[1:]
    found = alerts.with_keys(alerts.forecast_alerts(forecast(spark, [12.0] * 3)), ["push"])
    assert found.first().alert_key == "push|Stockholm|Birch|forecast|2026-05-01"
