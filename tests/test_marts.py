import datetime as dt

import pandas as pd
import pytest

from stationlake.model import SOURCES, raw_schema
from stationlake.plans import marts
from tests.helpers import daily_table, days, hours, rows


def air(spark, listed):
    """(city, time, birch) rows as a raw air table."""
    names = SOURCES["air_quality"]
    full = [
        (c, t, *[{"birch_pollen": b, "ozone": 50.0}.get(v) for v in names], dt.datetime(2025, 1, 1))
        for c, t, b in listed
    ]
    return spark.createDataFrame(full, raw_schema(names))


def weather(spark, listed):
    names = SOURCES["weather"]
    full = [
        (c, t, *[{"temperature_2m": x, "precipitation": 0.5}.get(v) for v in names], dt.datetime(2025, 1, 1))
        for c, t, x in listed
    ]
    return spark.createDataFrame(full, raw_schema(names))


def chain(spark, start, n, missing=()):
    ts = hours(start, n)
    a = marts.stage_air_quality(air(spark, [("a", t, 1.0) for t in ts]))
    w = marts.stage_weather(weather(spark, [("a", t, 10.0) for i, t in enumerate(ts) if i not in missing]))
    return marts.hourly(a, w)


def test_staging_fills_species_only(spark):
    row = marts.stage_air_quality(air(spark, [("a", dt.datetime(2024, 5, 1), None)])).first()
    assert (row.birch_pollen, row.alder_pollen, row.pm2_5, row.no2) == (0.0, 0.0, None, None)
    assert row.time_local == dt.datetime(2024, 5, 1, 2)


def test_hours_without_weather_stay(spark):
    got = rows(chain(spark, "2024-05-01", 3, missing=(1,)).select("time_utc", "temperature_c"), "time_utc")
    assert [r[1] for r in got] == [10.0, None, 10.0]


@pytest.mark.parametrize("start,day,n", [("2024-03-29", "2024-03-31", 23), ("2024-10-25", "2024-10-27", 25)])
def test_days_on_which_clocks_change(spark, start, day, n):
    daily = marts.daily(chain(spark, start, 120))
    counts = {str(r.date_local): r.n_hours for r in daily.collect()}
    assert counts[day] == n
    assert set(counts.values()) <= {23, 24, 25}


def test_partial_days_are_dropped(spark):
    daily = marts.daily(chain(spark, "2024-05-01T00:00:00", 30))
    assert daily.count() == 0
    assert marts.daily(chain(spark, "2024-05-01T00:00:00", 30), min_hours=1).count() == 2


def test_weekly_week_53(spark):
    frame = pd.DataFrame({"city": "a", "date_local": days("2020-12-28", 10), "birch_pollen_avg": range(10)})
    frame["birch_pollen_max"] = frame["birch_pollen_avg"] * 2
    got = rows(
        marts.weekly(daily_table(spark, frame)).select(
            "iso_year", "iso_week", "week_start", "birch_pollen_avg", "birch_pollen_max", "n_days"
        ),
        "iso_year", "iso_week",
    )
    assert got == [
        (2020, 53, dt.date(2020, 12, 28), 3.0, 12.0, 7),
        (2021, 1, dt.date(2021, 1, 4), 8.0, 18.0, 3),
    ]


def brute_seasons(frame, species, lo, hi):
    out = {}
    for s in species:
        col = f"{s}_pollen_avg"
        for (city, year), g in frame.groupby(["city", frame["date_local"].map(lambda d: d.year)]):
            g = g.dropna(subset=[col]).sort_values("date_local")
            total = g[col].sum()
            if not total > 0:
                continue
            run = g[col].cumsum()
            top = g[col].max()
            out[city, s, year] = (
                g.loc[run >= lo * total, "date_local"].min(),
                g.loc[g[col] == top, "date_local"].min(),
                g.loc[run >= hi * total, "date_local"].min(),
                top,
                total,
            )
    return out


@pytest.mark.parametrize("lo,hi", [(0.05, 0.95), (0.03, 0.97)])
def test_seasons_equal_a_loop(spark, lo, hi):
    import random

    rng = random.Random(11)
    listed = []
    for city in ("a", "b"):
        for d in days("2022-11-01", 500):
            if rng.random() < 0.1:
                continue
            birch = None if rng.random() < 0.1 else float(rng.choice([0, 0, 1, 5, 5, 9]))
            listed.append((city, d, birch, float(rng.randrange(3)) if city == "a" else 0.0))
    frame = pd.DataFrame(listed, columns=["city", "date_local", "birch_pollen_avg", "grass_pollen_avg"])
    got = {
        (r.city, r.pollen_type, r.year): (r.season_start, r.peak_date, r.season_end, r.peak_pollen, r.year_total)
        for r in marts.seasons(daily_table(spark, frame), lo=lo, hi=hi).collect()
    }
    expected = brute_seasons(frame, ["birch", "grass"], lo, hi)
    assert got == expected
    assert ("b", "grass", 2023) not in got


def test_seasons_use_one_shuffle(spark):
    frame = pd.DataFrame({"city": "a", "date_local": days("2024-01-01", 5), "birch_pollen_avg": 1.0})
    plan = marts.seasons(daily_table(spark, frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_missing_values(spark):
    raw = air(spark, [("a", t, None if i < 1 else 1.0) for i, t in enumerate(hours("2024-12-31T22:00", 3))])
    got = marts.missing_values({"air_quality": raw}).filter("variable = 'birch_pollen'")
    assert rows(got.select("year", "n_rows", "n_missing", "pct_missing"), "year") == [
        (2024, 2, 1, 50.0), (2025, 1, 0, 0.0)
    ]
