import datetime as dt

import pandas as pd
import pytest

from stationlake.model import measured_seasons
from stationlake.plans import climatology as cl
from stationlake.plans import planning as pl
from stationlake.plans import risk as rk
from stationlake.plans import statistics as st
from tests.helpers import daily_table, days, hours, rows, seasons_table

D = dt.date


def week_day(year, week):
    return D.fromisocalendar(year, week, 3)


def by_weeks(spark, listed):
    return seasons_table(
        spark,
        [(c, p, y, week_day(y, a), week_day(y, k), week_day(y, e), total) for c, p, y, a, k, e, total in listed],
    )


def test_stock_plan_rounds_half_to_even(spark):
    weeks = [(2021, 15), (2022, 16), (2023, 17), (2024, 18), (2025, 20), (2026, 21)]
    seasons = by_weeks(spark, [("a", "birch", y, w, w + 2, w + 5, 100.0 * i) for i, (y, w) in enumerate(weeks)])
    row = pl.stock_plan(seasons).first()
    expected = pd.Series([w for _, w in weeks]).quantile(0.1)
    assert row.earliest_start == pytest.approx(expected)
    assert (row.typical_start, row.stock_ready_week, row.yearly_pollen) == (17.5, round(expected - 1), 250.0)


def test_gaps_drop_years_missing_at_the_reference(spark):
    seasons = by_weeks(
        spark,
        [("Malmö", "birch", 2024, 15, 16, 17, 1), ("Luleå", "birch", 2024, 19, 20, 21, 1),
         ("Luleå", "birch", 2025, 30, 31, 32, 1), ("Malmö", "grass", 2025, 22, 23, 24, 1)],
    )
    got = rows(pl.start_gaps(seasons), "pollen_type", "city")
    assert got == [("Birch", "Luleå", 4.0, 4.0, 4.0), ("Birch", "Malmö", 0.0, 0.0, 0.0), ("Grass", "Malmö", 0.0, 0.0, 0.0)]


def test_coverage_is_a_share_of_years(spark):
    seasons = by_weeks(spark, [("a", "birch", 2024, 10, 11, 12, 1), ("a", "birch", 2025, 12, 13, 14, 1)])
    got = {r.week: r.in_season for r in pl.season_coverage(seasons).collect()}
    assert len(got) == 32 and (got[9], got[10], got[12], got[14], got[36]) == (0.0, 0.5, 1.0, 0.5, 0.0)


def test_regional_gap_floors_to_days(spark):
    listed = [("S1", D(2024, 4, 1)), ("S2", D(2024, 4, 2)), ("N1", D(2024, 4, 20))]
    seasons = seasons_table(spark, [(c, "birch", 2024, d, d, d) for c, d in listed])
    regions = spark.createDataFrame([("S1", "South"), ("S2", "South"), ("N1", "North")], "city string, region string")
    row = pl.regional_gap(seasons, regions).first()
    assert (row.gap_days, row.gap_weeks) == (18, 2.6)


def test_intensity_index(spark):
    seasons = by_weeks(spark, [("a", "birch", 2024, 15, 16, 17, 50), ("a", "birch", 2025, 15, 16, 17, 150)])
    assert [r["index"] for r in pl.intensity(seasons).orderBy("year").collect()] == [50.0, 150.0]


def test_data_labels(spark):
    plan = spark.createDataFrame(
        [("Birch", "Malmö"), ("Alder", "Malmö"), ("Alder", "Göteborg"), ("Mugwort", "Malmö")], "pollen_type string, city string"
    )
    got = {(r[0], r[1]): r[2] for r in pl.data_quality(plan).collect()}
    assert list(got.values()).count("weak") == 2 and got["Alder", "Göteborg"] == "ok" and got["Birch", "Malmö"] == "good"


def hourly_ozone(spark, listed):
    return spark.createDataFrame(
        [("a", t, t.date(), v) for t, v in listed], "city string, time_utc timestamp_ntz, date_local date, ozone double"
    )


def test_eight_hour_means_reach_over_midnight(spark):
    high = list(zip(hours("2024-05-01T18:00", 12), [120.0] * 6 + [96.0] * 6))
    got = dict(rows(rk.rolling_daily_max(hourly_ozone(spark, high)).select("date_local", "ozone_8h_max")))
    assert got[D(2024, 5, 1)] == 120.0
    assert got[D(2024, 5, 2)] == pytest.approx((120 * 6 + 96 * 1) / 7)


def risk_table(spark):
    frame = pd.DataFrame(
        {"city": "a", "date_local": days("2024-05-01", 4), "birch_pollen_avg": [150.0, 150.0, 150.0, 5.0],
         "pm2_5_avg": [20.0, 20.0, None, 20.0]}
    )
    ozone = [(dt.datetime(2024, 5, d, 12), v) for d, v in ((1, 130.0), (2, 10.0), (3, None), (4, 100.0))]
    days_ = daily_table(spark, frame)
    return days_, rk.risk_days(days_, hourly_ozone(spark, ozone))


def test_risk_days_and_causes(spark):
    _, risk = risk_table(spark)
    got = rows(risk.select("date_local", "bad_ozone", "bad_pm25", "both", "cause"), "date_local")
    assert [r[1:] for r in got] == [
        (True, True, True, "Ozone"), (False, True, True, "PM2.5 (fine particles)"),
        (False, False, False, "PM2.5 (fine particles)"), (False, True, False, "PM2.5 (fine particles)"),
    ]
    months = rows(rk.risk_by_month(risk), "month")
    assert months == [(m, 1 if m == 5 else 0, 1 if m == 5 else 0) for m in range(3, 10)]
    head = rk.risk_headline(risk).first()
    assert tuple(head) == (3, 3, 2, 1, 2)


def test_event_days_count_any_problem(spark):
    days_, risk = risk_table(spark)
    flagged = pl.event_days(days_, risk)
    assert [r.problem for r in flagged.orderBy("date_local").collect()] == [True, True, True, True]
    factors = {r.factor: r.share for r in pl.event_factors(flagged).collect()}
    assert factors == {"Rain (≥ 1 mm)": 0.0, "Bad air (PM2.5 or ozone)": 0.75, "Hot (≥ 25 °C)": 0.0}


def test_pooled_and_site_means_differ_with_unequal_days(spark):
    listed = [("a", 18, True)] + [("b", 18, False)] * 3
    df = spark.createDataFrame(listed, "city string, week int, rain boolean").selectExpr(
        "*", "rain AS bad_air", "rain AS hot", "rain AS problem"
    )
    assert {r.share for r in pl.event_factors(df).collect()} == {0.25}
    assert {r.share for r in pl.event_factors_site_mean(df).collect()} == {0.5}
    row = pl.best_and_worst_week(pl.event_risk(df)).first()
    assert (row.best_week, row.best_share, row.worst_week, row.worst_share) == (18, 0.5, 18, 0.5)


def test_retail_headline_breaks_ties_by_month_and_name(spark):
    listed = [("b", 4, 0.5, 0.1), ("a", 4, 0.5, 0.1), ("a", 3, 0.5, 0.1), ("b", 3, 0.5, 0.1)]
    need = spark.createDataFrame(listed, "city string, month int, high_days double, pm25_days double")
    assert tuple(pl.retail_headline(need).first()) == (3, 3, "a")


def test_safe_weeks(spark):
    listed = [("a", w, "High pollen", 0.0 if w in (14, 20, 21, 22, 36) else 0.2) for w in range(10, 39)]
    calendar = spark.createDataFrame(listed, "city string, week int, level string, share double")
    assert rows(rk.safe_weeks(calendar)) == [("a", "14, 20–22")]


def test_trigger_counts_back_calendar_days(spark):
    listed = days("2024-01-30", 10)
    del listed[6]  # 5 February is missing
    frame = pd.DataFrame({"city": "a", "date_local": listed, "birch_pollen_avg": [50.0, 50.0, 5.0, 5.0, 20.0, 20.0, 20.0, 5.0, 5.0]})
    triggers = st.campaign_trigger(daily_table(spark, frame))
    # The run ends on the 6th after a gap; two calendar days back is the 4th.
    assert rows(triggers) == [("a", 2024, D(2024, 2, 4))]
    quiet = daily_table(spark, frame.assign(birch_pollen_avg=1.0))
    assert rows(st.campaign_trigger(quiet)) == [("a", 2024, None)]


def test_trigger_against_the_fixed_date(spark):
    triggers = spark.createDataFrame([("a", 2024, D(2024, 4, 10)), ("a", 2025, None)], "city string, year int, trigger date")
    seasons = seasons_table(spark, [("a", "birch", y, D(y, 4, 12), D(y, 4, 20), D(y, 5, 1)) for y in (2024, 2025)])
    got = dict(rows(st.trigger_summary(st.trigger_vs_fixed(triggers, seasons)).select("campaign_start", "median_days")))
    assert got == {"Pollen trigger": -2.0, "Fixed date (1 April)": -11.0}


def test_trend_adjustment(spark):
    got = {r.pollen_type: r for r in st.trend_adjusted(measured_seasons(spark)).collect()}
    assert got["Birch"].start == pytest.approx(117.85 - 0.31 * (2023 - 1998.5))
    assert got["Alder"].spin == pytest.approx(1442.33 + 35.25 * 12)


def test_sample_size_formula(spark):
    listed = [("x", 100.0 + d, 50.0 + d * s) for d, s in ((-30, 1), (0, -1), (30, 1), (10, 1))]
    units = spark.createDataFrame(listed, "stratum string, sales double, before double")
    df = pd.DataFrame(listed, columns=["s", "v", "b"])
    cv, rho = df["v"].std() / df["v"].mean(), df["v"].corr(df["b"])
    for r in st.sample_size(units, ["stratum"], "sales", "before").collect():
        assert r.per_group == round(2 * 2.8**2 * cv**2 / r.lift**2)
        assert r.per_group_adjusted == round(2 * 2.8**2 * cv**2 * (1 - rho**2) / r.lift**2)


def test_drivers_use_the_summer_before(spark):
    frame = pd.DataFrame({"city": "a", "date_local": days("2023-01-01", 730), "birch_pollen_avg": 1.0})
    frame["temperature_avg_c"] = [{2023: 20.0, 2024: 10.0}[d.year] + d.month for d in frame["date_local"]]
    days_ = daily_table(spark, frame)
    seasons = seasons_table(spark, [("a", "birch", y, D(y, 4, 1), D(y, 4, 2), D(y, 4, 30)) for y in (2023, 2024)])
    got = {r.year: r for r in st.season_drivers(pl.intensity(seasons), days_, seasons).collect()}
    assert got[2023].prev_summer_temp is None
    assert got[2024].prev_summer_temp == pytest.approx(20 + (6 * 30 + 7 * 31) / 61)
    assert got[2024].season_temp == pytest.approx(14.0)


def test_typical_season_of_even_years_keeps_half_days(spark):
    seasons = seasons_table(spark, [("a", "birch", y, D(y, 4, 10 + i), D(y, 4, 20), D(y, 5, 1)) for i, y in enumerate((2022, 2023))])
    row = cl.typical_seasons(seasons).first()
    assert (row.pollen_type, row.start_doy) == ("Birch", 100.5)
    assert cl.typical_calendar(seasons).first().start == dt.datetime(2000, 4, 10, 12)


def test_calendar_keeps_52_weeks(spark):
    frame = pd.DataFrame({"iso_week": [52, 53], "birch_pollen_avg": [1.0, 9.0]})
    weeks = spark.createDataFrame(
        [("a", 2020, w, 0.0, b, 0.0, 0.0) for w, b in frame.itertuples(index=False)],
        "city string, iso_year int, iso_week int, alder_pollen_avg double, birch_pollen_avg double, grass_pollen_avg double, mugwort_pollen_avg double",
    )
    assert {r.iso_week for r in cl.weekly_climatology(weeks).collect()} == {52}


def test_profile_index_and_lowest_hour(spark):
    listed = [("a", D(2024, 5, 1), h, 0.0, float(v), 0.0, 0.0) for h, v in enumerate((3, 1, 1, 7))]
    hours_ = spark.createDataFrame(
        listed, "city string, date_local date, hour_local int, alder_pollen double, birch_pollen double, grass_pollen double, mugwort_pollen double"
    )
    season = seasons_table(spark, [("a", "birch", 2024, D(2024, 5, 1), D(2024, 5, 1), D(2024, 5, 1))])
    profile = cl.hour_profile(hours_, season)
    assert [r["index"] for r in profile.orderBy("hour_local").collect()] == pytest.approx([100.0, 100 / 3, 100 / 3, 700 / 3])
    row = cl.lowest_highest_hour(profile).first()
    assert (row.hour_local_low, row.hour_local_high) == (1, 3)
