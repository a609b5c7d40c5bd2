"""Typical seasons, weekly calendars, profiles of the day, monthly context."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from stationlake.plans import climatology as cl
from stationlake.plans import hours as hr
from stationlake.plans import marts
from stationlake.sources.tables import latest_forecast
from workload import sql
from workload.fixtures import HIGH, event_hours, forecast_snapshots, obs_daily, stored
from workload.mart_queries import hourly_mart
from workload.registry import register

SEASONS = [sql.SITE_LINES, sql.obs_daily(), sql.seasons()]
CAP = sql.capital()
DOY = ["start_doy", "peak_doy", "end_doy"]


def seasons_of(spark, sf, site: str = "r_name"):
    return marts.seasons(obs_daily(spark, sf, site))


def days_and_seasons(spark, sf, site: str = "r_name"):
    days = stored(obs_daily(spark, sf, site), "days")
    return days, marts.seasons(days)


@register(
    "seasons_with_doy",
    sql.query(
        SEASONS,
        f"""SELECT * REPLACE ({CAP} AS pollen_type), dayofyear(season_start) AS start_doy,
              dayofyear(peak_date) AS peak_doy, dayofyear(season_end) AS end_doy FROM seasons""",
        ["peak_pollen", "year_total"],
        DOY,
    ),
)
def _(spark, sf):
    return cl.seasons_with_doy(seasons_of(spark, sf))


@register("typical_seasons", sql.query([*SEASONS, sql.TYPICAL], "SELECT * FROM typical", DOY))
def _(spark, sf):
    return cl.typical_seasons(seasons_of(spark, sf))


def _middle(column: str) -> str:
    md = f"make_date(2000, month({column}), day({column}))"
    days = f"median(date_diff('day', DATE '1970-01-01', {md}))"
    return f"TIMESTAMP '1970-01-01' + to_hours(({days} * 24)::INTEGER)"


@register(
    "typical_calendar_2000",
    sql.query(
        SEASONS,
        f"""SELECT {CAP} AS pollen_type, city,
              {_middle("season_start")} AS start, {_middle("peak_date")} AS peak,
              {_middle("season_end")} AS "end",
              median(start_week) AS start_week, median(peak_week) AS peak_week,
              median(end_week) AS end_week
            FROM seasons GROUP BY ALL""",
        ["start_week", "peak_week", "end_week"],
    ),
)
def _(spark, sf):
    return cl.typical_calendar(seasons_of(spark, sf))


WEEKS = [sql.SITE_LINES, sql.obs_daily(), sql.weekly()]
WEEK_LONG = " UNION ALL ".join(
    f"SELECT city, iso_year, iso_week, '{s.capitalize()}' AS pollen_type, {s}_pollen_avg AS grains "
    "FROM weekly WHERE iso_week <= 52"
    for s in sql.SPECIES
)


@register("weekly_by_year", sql.query(WEEKS, WEEK_LONG, ["grains"]))
def _(spark, sf):
    return cl.weekly_by_year(marts.weekly(obs_daily(spark, sf)))


@register(
    "weekly_climatology",
    sql.query(
        WEEKS,
        f"SELECT pollen_type, city, iso_week, avg(grains) AS grains FROM ({WEEK_LONG}) GROUP BY ALL",
        ["grains"],
    ),
)
def _(spark, sf):
    return cl.weekly_climatology(marts.weekly(obs_daily(spark, sf)))


@register(
    "daily_flags",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily()],
        f"""SELECT *, year(date_local) AS year, month(date_local) AS month, week(date_local) AS week,
              {", ".join(f'{s}_pollen_avg > {HIGH[s]} AS "high_{s.capitalize()}"' for s in sql.SPECIES)},
              {sql.any_above(HIGH)} AS high_any
            FROM obs_daily""",
        ints=["year", "month", "week"],
    ),
)
def _(spark, sf):
    return cl.daily_flags(obs_daily(spark, sf), levels=HIGH)


HOURS = [*sql.MART_CHAIN[:-1], sql.obs_daily(), sql.seasons()]


def _profile(groups: str, by: str) -> str:
    """One list of readings per hour of a season, then means of the lists, then their share of the mean hour."""
    readings = " UNION ALL ".join(
        f"SELECT city, date_local, hour_local, '{s}' AS pollen_type, {s}_pollen AS reading FROM hourly" for s in sql.SPECIES
    )
    return f"""
readings AS ({readings}),
in_season AS (
  SELECT r.* FROM readings r SEMI JOIN seasons s
    ON r.pollen_type = s.pollen_type AND r.city = s.city
   AND r.date_local >= s.season_start AND r.date_local <= s.season_end AND s.year = extract(year FROM r.date_local)
),
by_hour AS (
  SELECT {groups}, hour_local, list(reading) FILTER (WHERE reading IS NOT NULL) AS seen FROM in_season GROUP BY {groups}, hour_local
),
means AS (SELECT * EXCLUDE (seen), list_sum(seen) / nullif(len(seen), 0) AS grains FROM by_hour),
whole AS (SELECT {by}, sum(grains) / count(grains) AS usual FROM means GROUP BY {by}),
profile AS (
  SELECT means.* REPLACE (upper(left(means.pollen_type, 1)) || substr(means.pollen_type, 2) AS pollen_type),
    100 * grains / CASE WHEN usual <> 0 THEN usual END AS index
  FROM means JOIN whole USING ({by})
)"""


BY_SITE = _profile("city, pollen_type", "city, pollen_type")


def profile_of(spark, sf, pooled=False):
    return cl.hour_profile(hourly_mart(spark, sf), seasons_of(spark, sf), pooled=pooled)


@register(
    "hour_profile_index", sql.query([*HOURS, BY_SITE], "SELECT * FROM profile", ["grains", "index"])
)
def _(spark, sf):
    return profile_of(spark, sf)


@register(
    "hour_profile_pooled",
    sql.query(
        [*HOURS, _profile("pollen_type", "pollen_type")],
        "SELECT * FROM profile",
        ["grains", "index"],
    ),
)
def _(spark, sf):
    return profile_of(spark, sf, pooled=True)


@register(
    "mean_hour_profile_low",
    sql.query(
        [
            *HOURS,
            BY_SITE,
            "mean AS (SELECT pollen_type, hour_local, avg(index) AS index FROM profile GROUP BY ALL)",
        ],
        """SELECT pollen_type, hour_local, index FROM mean
           QUALIFY row_number() OVER (PARTITION BY pollen_type ORDER BY index, hour_local) = 1""",
        ["index"],
    ),
)
def _(spark, sf):
    return cl.lowest_hour(cl.mean_profile(profile_of(spark, sf)), ["pollen_type"])


@register(
    "lowest_highest_hour",
    sql.query(
        [*HOURS, BY_SITE],
        """SELECT a.pollen_type, a.city, a.hour_local AS hour_local_low, a.index AS index_low,
             b.hour_local AS hour_local_high, b.index AS index_high
           FROM (SELECT * FROM profile QUALIFY row_number() OVER
                   (PARTITION BY pollen_type, city ORDER BY index, hour_local) = 1) a
           JOIN (SELECT * FROM profile QUALIFY row_number() OVER
                   (PARTITION BY pollen_type, city ORDER BY index DESC, hour_local) = 1) b
             USING (pollen_type, city)""",
        ["index_low", "index_high"],
    ),
)
def _(spark, sf):
    return cl.lowest_highest_hour(profile_of(spark, sf))


@register(
    "monthly_context",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily()],
        """SELECT city, month(date_local) AS month, avg(temperature_avg_c) AS temperature_c,
             sum(precipitation_mm) / count(DISTINCT year(date_local)) AS rain_mm
           FROM obs_daily GROUP BY ALL""",
        ["temperature_c", "rain_mm"],
        ["month"],
    ),
)
def _(spark, sf):
    return cl.monthly_context(obs_daily(spark, sf))


@register(
    "timeline_span",
    sql.query(
        [*SEASONS, sql.TYPICAL],
        """SELECT pollen_type, min(start_doy) AS start, max(end_doy) AS "end",
             min(peak_doy) AS peak_from, max(peak_doy) AS peak_to FROM typical GROUP BY ALL""",
        ["start", "end", "peak_from", "peak_to"],
    ),
)
def _(spark, sf):
    return cl.timeline(cl.typical_seasons(seasons_of(spark, sf)))


HIGH_PER_YEAR = " UNION ALL ".join(
    f"""SELECT '{s.capitalize()}' AS pollen_type,
          (count(*) FILTER (WHERE {s}_pollen_avg > {HIGH[s]}))::DOUBLE
          / count(DISTINCT year(date_local)) / count(DISTINCT city) AS high_days_per_year
        FROM obs_daily"""
    for s in sql.SPECIES
)


@register(
    "season_headline",
    sql.query(
        [
            *HOURS,
            sql.TYPICAL,
            BY_SITE,
            "mean AS (SELECT pollen_type, hour_local, avg(index) AS index FROM profile GROUP BY ALL)",
            f"high_days AS ({HIGH_PER_YEAR})",
        ],
        """SELECT t.pollen_type, t.start_doy, t.peak_doy, m.hour_local AS cleanest_hour,
             d.high_days_per_year
           FROM (SELECT pollen_type, median(start_doy) AS start_doy, median(peak_doy) AS peak_doy
                 FROM typical GROUP BY ALL) t
           JOIN (SELECT * FROM mean QUALIFY row_number() OVER
                   (PARTITION BY pollen_type ORDER BY index, hour_local) = 1) m USING (pollen_type)
           JOIN high_days d USING (pollen_type)""",
        ["start_doy", "peak_doy", "high_days_per_year"],
    ),
)
def _(spark, sf):
    days = obs_daily(spark, sf)
    return cl.season_headline(
        cl.typical_seasons(seasons_of(spark, sf)),
        profile_of(spark, sf),
        cl.daily_flags(days, levels=HIGH),
    )


@register(
    "coverage",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily()],
        """SELECT count(DISTINCT city) AS n_cities, min(date_local) AS first_day,
             max(date_local) AS last_day FROM obs_daily""",
        longs=["n_cities"],
    ),
)
def _(spark, sf):
    return cl.data_coverage(obs_daily(spark, sf))


# --- hours around a date ---------------------------------------------------

POLLEN = [f"{s}_pollen" for s in sql.SPECIES]
MEANS = ", ".join(f"avg({c}) AS {c}" for c in POLLEN)


def _typical(start: str, end: str) -> str:
    """Typical course for [start, end) from every year the daily table covers."""
    return f"""
years AS (
  SELECT y, (DATE '{start}' + to_years(y - year(DATE '{start}')))::DATE AS s,
    (DATE '{end}' + to_years(y - year(DATE '{start}')))::DATE AS e
  FROM (SELECT unnest(generate_series((SELECT min(year(date_local)) FROM obs_daily),
                                      (SELECT max(year(date_local)) FROM obs_daily)))::INTEGER AS y)
),
covered AS (
  SELECT * FROM years WHERE s >= (SELECT min(date_local) FROM obs_daily)
    AND e <= (SELECT max(date_local) + 1 FROM obs_daily)
),
typical_hours AS (
  SELECT h.city, h.time_local + to_days((DATE '{start}' - c.s)::INTEGER) AS time, {MEANS},
    list_sort(list(DISTINCT c.y)) AS years
  FROM hourly h JOIN covered c ON h.time_local >= c.s AND h.time_local < c.e
  GROUP BY ALL
)"""


@register(
    "typical_window",
    sql.query(
        [*sql.MART_CHAIN[:-1], sql.obs_daily(), _typical("2004-02-27", "2004-03-05")],
        "SELECT * FROM typical_hours",
        POLLEN,
    ),
)
def _(spark, sf):
    return hr.typical_window(
        hourly_mart(spark, sf), obs_daily(spark, sf), date(2004, 2, 27), date(2004, 3, 5)
    )


@register(
    "site_hour_window",
    sql.query(
        sql.MART_CHAIN[:-1],
        f"""SELECT city, time_local AS time, {", ".join(POLLEN)} FROM hourly
            WHERE time_local >= '1998-03-27' AND time_local < '1998-04-03' AND city IN ('ASIA', 'EUROPE')""",
    ),
)
def _(spark, sf):
    """Two sites are known; the hours of others are not returned."""
    known = spark.createDataFrame([("ASIA",), ("EUROPE",), ("ATLANTIS",)], "city string")
    return hr.hour_window(hourly_mart(spark, sf), date(1998, 3, 27), date(1998, 4, 3), sites=known)


@register(
    "one_site_hour_window",
    sql.query(
        sql.MART_CHAIN[:-1],
        """SELECT city, time_local AS time, birch_pollen FROM hourly
            WHERE time_local >= '1998-03-27' AND time_local < '1998-04-03' AND city = 'ASIA'""",
    ),
)
def _(spark, sf):
    window = hr.hour_window(hourly_mart(spark, sf), date(1998, 3, 27), date(1998, 4, 3), columns=["birch_pollen"], site="ASIA")
    return window


def forecast_of(spark, sf):
    return latest_forecast(
        forecast_snapshots(spark, sf), POLLEN, as_of=datetime(2024, 1, 28, 12)
    )


FORECAST = f"""
forecast AS (
  SELECT city, fetched_at, fetched_at AS "current_time", time, {", ".join(POLLEN)}
  FROM snapshots s
  WHERE fetched_at = (SELECT max(fetched_at) FROM snapshots x
                      WHERE x.city = s.city AND x.fetched_at <= '2024-01-28 12:00')
    AND time >= date_trunc('day', fetched_at) - to_days(2)
    AND time < date_trunc('day', fetched_at) + to_days(4)
    AND coalesce({", ".join(POLLEN)}) IS NOT NULL
)"""


@register(
    "latest_forecast",
    sql.query([sql.EVENT_HOURS, sql.SNAPSHOTS, FORECAST], "SELECT * FROM forecast"),
)
def _(spark, sf):
    return forecast_of(spark, sf)


def event_marts(spark, sf):
    """Hourly and daily table of the events, in UTC, unknown counts as zero."""
    zero = {c: 0.0 for c in POLLEN}
    hours = event_hours(spark, sf).fillna(zero).select(
        "city",
        F.col("time").alias("time_utc"),
        F.col("time").alias("time_local"),
        F.to_date("time").alias("date_local"),
        *POLLEN,
    )
    days = hours.select("city", "date_local").distinct()
    return hours, days


EVENT_MARTS = [
    sql.EVENT_HOURS,
    f"""hourly AS (SELECT city, time AS time_utc, time AS time_local, time::DATE AS date_local,
          {", ".join(f"coalesce({c}, 0) AS {c}" for c in POLLEN)} FROM event_hours)""",
    "obs_daily AS (SELECT DISTINCT city, date_local FROM hourly)",
]


@register(
    "best_source_history",
    sql.query(
        EVENT_MARTS,
        f"""SELECT city, time_local AS time, {", ".join(POLLEN)}, 'history' AS kind FROM hourly
            WHERE time_local >= '2024-01-08' AND time_local < '2024-01-15'""",
    ),
)
def _(spark, sf):
    hours, days = event_marts(spark, sf)
    return hr.best_source(hours, days, forecast_of(spark, sf), date(2024, 1, 10), date(2024, 2, 1))


@register(
    "best_source_forecast",
    sql.query(
        [*EVENT_MARTS, sql.SNAPSHOTS, FORECAST],
        f"""SELECT city, time, {", ".join(POLLEN)}, 'forecast' AS kind FROM forecast f
            WHERE EXISTS (SELECT 1 FROM forecast x WHERE x.city = f.city AND x.time::DATE = DATE '2024-01-30')""",
    ),
)
def _(spark, sf):
    hours, days = event_marts(spark, sf)
    before = days.filter(F.col("date_local") < "2024-01-30")
    return hr.best_source(
        hours, before, forecast_of(spark, sf), date(2024, 1, 30), date(2024, 1, 29)
    ).filter(F.col("kind") == "forecast")


@register(
    "best_source_typical",
    sql.query(
        [*EVENT_MARTS, _typical("2030-01-08", "2030-01-15")],
        f"""SELECT city, time, {", ".join(POLLEN)}, 'typical' AS kind FROM typical_hours""",
        POLLEN,
    ),
)
def _(spark, sf):
    hours, days = event_marts(spark, sf)
    return hr.best_source(hours, days, forecast_of(spark, sf), date(2030, 1, 10), date(2024, 2, 1))


@register(
    "best_source_all",
    sql.query(
        [
            *EVENT_MARTS,
            sql.SNAPSHOTS,
            FORECAST,
            _typical("2025-01-24", "2025-01-31"),
            "later AS (SELECT * REPLACE (time + to_days(366) AS time) FROM forecast WHERE city <> 'click')",
            "ahead AS (SELECT DISTINCT city FROM later WHERE time::DATE = DATE '2025-01-26')",
        ],
        f"""SELECT city, time, {", ".join(POLLEN)}, 'forecast' AS kind FROM later SEMI JOIN ahead USING (city)
            UNION ALL SELECT city, time, {", ".join(POLLEN)}, 'typical' FROM typical_hours ANTI JOIN ahead USING (city)""",
        POLLEN,
    ),
)
def _(spark, sf):
    """A day after the stored ones: each site has its forecast, or typical values where no forecast reaches the day."""
    hours, days = event_marts(spark, sf)
    later = F.timestamp_add("DAY", F.lit(366), F.col("time"))
    some = forecast_of(spark, sf).filter(F.col("city") != "click").withColumn("time", later)
    return hr.best_source(hours, days, some, date(2025, 1, 26), date(2025, 1, 20))


SUMMARY_LEVEL = {s: 9000.0 for s in sql.SPECIES}
LONG_DAY = " UNION ALL ".join(
    f"SELECT city, time, {i} AS ord, '{s.capitalize()}' AS pollen_type, {s}_pollen AS v FROM event_hours"
    for i, s in enumerate(sql.SPECIES)
)


@register(
    "day_summary",
    sql.query(
        [sql.EVENT_HOURS, f"long_day AS ({LONG_DAY})"],
        """SELECT city, pollen_type, v AS peak, hour(time) AS peak_hour,
             CASE WHEN v > 9000 THEN 'high' ELSE 'present' END AS level
           FROM long_day WHERE time::DATE = DATE '2024-01-10' AND v IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY city ORDER BY v DESC, ord, time) = 1""",
        ["peak"],
        ["peak_hour"],
    ),
)
def _(spark, sf):
    return hr.day_summary(event_hours(spark, sf), date(2024, 1, 10), levels=SUMMARY_LEVEL)
