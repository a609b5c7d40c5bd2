import datetime as dt
import random

import pandas as pd
import pytest

from stationlake.model import WEATHER_SPECIES
from stationlake.plans import climatology as cl
from stationlake.plans import marts, weather
from tests.helpers import daily_table, days, rows, seasons_table


def random_days(seed, cities=("a", "b"), n=420):
    rng = random.Random(seed)
    listed = []
    for city in cities:
        for d in days("2023-06-01", n):
            if rng.random() < 0.05:
                continue
            rain = None if rng.random() < 0.05 else rng.choice([0.0, 0.0, 0.05, 0.1, 1.0, 2.0, 5.0])
            listed.append((city, d, rain, *[rng.choice([None, 0.0, 0.5, 1.0, 4.0, 5.0, 8.0]) for _ in WEATHER_SPECIES]))
    return pd.DataFrame(
        listed, columns=["city", "date_local", "precipitation_mm", *[f"{s}_pollen_avg" for s in WEATHER_SPECIES]]
    )


def brute_events(frame, seasons):
    """Events found by walking through each site's days."""
    out = []
    for s in seasons:
        col = f"{s.pollen_type}_pollen_avg"
        line = frame[frame["city"] == s.city].sort_values("date_local").to_dict("records")
        for i, now in enumerate(line):
            if not (s.season_start <= now["date_local"] <= s.season_end):
                continue
            if i == 0 or i + 7 >= len(line):
                continue
            before = line[i - 1]
            if now["precipitation_mm"] < 2 or before["precipitation_mm"] >= 0.1 or before[col] < 1:
                continue
            level = before[col]
            back = [k for k in range(1, 8) if line[i + k][col] >= 0.8 * level]
            drop = now[col] / level
            out.append(
                (s.city, s.pollen_type.capitalize(), now["date_local"],
                 None if pd.isna(drop) else round(drop, 9), back[0] if back else None)
            )
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rain_events_equal_a_walk_over_the_days(spark, seed):
    frame = random_days(seed)
    table = daily_table(spark, frame)
    seasons = marts.seasons(table, {s: f"{s}_pollen_avg" for s in WEATHER_SPECIES})
    got = sorted(
        (
            (r.city, r.pollen_type, r.date_local, None if r.drop is None else round(r.drop, 9), r.recovery_days)
            for r in weather.rain_events(table, seasons).select("city", "pollen_type", "date_local", "drop", "recovery_days").collect()
        ),
        key=repr,
    )
    expected = brute_events(frame, seasons.collect())
    assert expected and got == expected


def test_season_days_and_ratio(spark):
    frame = pd.DataFrame(
        {"city": "a", "date_local": days("2024-05-01", 6), "birch_pollen_avg": [1.0, 2.0, 4.0, 6.0, 0.0, 50.0]}
    )
    season = seasons_table(spark, [("a", "birch", 2024, dt.date(2024, 5, 2), dt.date(2024, 5, 4), dt.date(2024, 5, 5))])
    got = cl.season_days(daily_table(spark, frame), season)
    assert rows(got.select("date_local", "grains", "ratio"), "date_local") == [
        (dt.date(2024, 5, 2), 2.0, 2 / 3), (dt.date(2024, 5, 3), 4.0, 4 / 3),
        (dt.date(2024, 5, 4), 6.0, 2.0), (dt.date(2024, 5, 5), 0.0, 0.0),
    ]


def test_ratio_of_an_empty_season_is_unknown(spark):
    frame = pd.DataFrame({"city": "a", "date_local": days("2024-05-01", 2), "birch_pollen_avg": 0.0})
    season = seasons_table(spark, [("a", "birch", 2024, dt.date(2024, 5, 1), dt.date(2024, 5, 1), dt.date(2024, 5, 2))])
    assert [r.ratio for r in cl.season_days(daily_table(spark, frame), season).collect()] == [None, None]


def test_small_groups_are_hidden(spark):
    listed = [("Birch", 1.0, "Dry")] * 15 + [("Birch", 3.0, "Rainy")] * 14 + [("Birch", 3.0, None)] * 20
    df = spark.createDataFrame(listed, "pollen_type string, ratio double, Rain string")
    assert rows(weather.weather_effect(df, ["Rain"])) == [("Rain", "Birch", "Dry", 1.0, 15)]


def test_recovery_shares(spark):
    listed = [("Birch", "a", k, 0.5) for k in (1, 2, 2, 5, None)]
    events = spark.createDataFrame(listed, 'pollen_type string, city string, recovery_days int, `drop` double')
    curve = [round(r.share, 3) for r in weather.recovery_curve(events).orderBy("days_after_rain").collect()]
    assert curve == [0.0, 0.2, 0.6, 0.6, 0.6, 0.8, 0.8, 0.8]
    summary = weather.rain_event_summary(events).first()
    assert (summary.events, summary.median_drop, summary.median_recovery_days) == (5, 0.5, 2.0)
    assert (summary.recovered_within, summary.not_recovered) == (0.6, 0.2)
    site = weather.recovery_by_site(events).first()
    assert (site.n, site.within_2_days, site.weak) == (5, 0.6, True)


def test_paired_effects_against_pandas(spark):
    rng = random.Random(4)
    listed = [
        ("Birch", rng.choice("ab"), rng.uniform(0, 3), rng.choice([0.0, 0.05, 1.0, 2.0, 7.0]),
         float(rng.randrange(30)), float(rng.randrange(5, 30)))
        for _ in range(300)
    ]
    names = ["pollen_type", "city", "ratio", "precipitation_mm", "wind_speed_avg_kmh", "temperature_max_c"]
    df = pd.DataFrame(listed, columns=names)
    got = {(r.city, r.effect): r.times for r in weather.paired_effects(spark.createDataFrame(df)).collect()}
    for city, g in df.groupby("city"):
        wind = g["wind_speed_avg_kmh"]
        expected = (
            g.loc[wind >= wind.quantile(2 / 3), "ratio"].mean() / g.loc[wind <= wind.quantile(1 / 3), "ratio"].mean()
        )
        assert got[city, "Wind (windy vs calm)"] == pytest.approx(expected)
        rain = g["precipitation_mm"]
        assert got[city, "Rain (rainy vs dry)"] == pytest.approx(
            g.loc[rain >= 2, "ratio"].mean() / g.loc[rain < 0.1, "ratio"].mean()
        )


def test_box_statistics_keep_null_groups(spark):
    given = [(g, float(v)) for g in ("a", None) for v in [*range(1, 12), 60]]
    got = weather.box_statistics(spark.createDataFrame(given, "city string, grains double"), ["city"])
    listed = {r["city"]: (r["q1"], r["median"], r["q3"], r["n"], r["whisker_low"], r["whisker_high"], r["outliers"]) for r in got.collect()}
    assert listed == dict.fromkeys(["a", None], (3.75, 6.5, 9.25, 12, 1.0, 11.0, 1))


def test_cuts_meet_a_hot_site_in_many_tasks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        days = spark.range(3000).selectExpr("IF(id % 3 = 0, 'hot', string(id % 50)) AS city", "double(id % 97) AS grains")
        plan = weather.box_statistics(days, ["city"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = [line for line in plan.splitlines() if "Join" in line and "__spread" in line]
    assert join and "BroadcastExchange" not in plan
