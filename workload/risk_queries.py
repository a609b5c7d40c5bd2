"""High days, allergy calendars, days with high counts and bad air."""

from __future__ import annotations

from stationlake.model import CAUSES
from stationlake.plans import climatology as cl
from stationlake.plans import risk as rk
from workload import sql
from workload.fixtures import HIGH, MODERATE, OZONE, PM25, obs_daily
from workload.mart_queries import hourly_mart
from workload.registry import register

DAYS = [sql.SITE_LINES, sql.obs_daily()]
FLAGS = f"""
flags AS (
  SELECT city, date_local, pm2_5_avg, precipitation_mm, temperature_max_c,
    year(date_local)::INTEGER AS year, month(date_local)::INTEGER AS month,
    week(date_local)::INTEGER AS week, {sql.any_above(HIGH)} AS high_any
  FROM obs_daily
)"""


def flags_of(spark, sf):
    return cl.daily_flags(obs_daily(spark, sf), levels=HIGH)


@register(
    "risk_calendar",
    sql.query(
        [*DAYS, FLAGS],
        """SELECT city, week, avg(high_any::INTEGER) AS high_any FROM flags
           WHERE week BETWEEN 10 AND 38 GROUP BY ALL""",
        ["high_any"],
    ),
)
def _(spark, sf):
    return rk.risk_calendar(flags_of(spark, sf))


@register(
    "risk_calendar_by_year",
    sql.query(
        [*DAYS, FLAGS],
        """SELECT city, year, week, avg(high_any::INTEGER) AS high_any FROM flags
           WHERE week BETWEEN 10 AND 38 GROUP BY ALL""",
        ["high_any"],
    ),
)
def _(spark, sf):
    return rk.risk_calendar(flags_of(spark, sf), by_year=True)


def _level(name: str, condition: str) -> str:
    return f"""SELECT city, week(date_local)::INTEGER AS week, '{name}' AS level,
                 avg({condition}::INTEGER) AS share
               FROM obs_daily WHERE week(date_local) BETWEEN 10 AND 38 GROUP BY ALL"""


CALENDAR = f"""calendar AS (
  {_level("High pollen", sql.any_above(HIGH))}
  UNION ALL {_level("Moderate or high pollen", sql.any_above(MODERATE))}
)"""


@register("allergy_calendar", sql.query([*DAYS, CALENDAR], "SELECT * FROM calendar", ["share"]))
def _(spark, sf):
    return rk.allergy_calendar(obs_daily(spark, sf), high=HIGH, moderate=MODERATE)


SAFE_BELOW = 0.5


@register(
    "safe_week_ranges",
    sql.query(
        [
            *DAYS,
            CALENDAR,
            f"""safe AS (SELECT city, week, week - row_number() OVER (PARTITION BY city ORDER BY week) AS g
                 FROM calendar WHERE level = 'High pollen' AND week BETWEEN 14 AND 35 AND share < {SAFE_BELOW})""",
            "islands AS (SELECT city, g, min(week) AS a, max(week) AS b FROM safe GROUP BY ALL)",
        ],
        """SELECT city, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) AS weeks
           FROM islands GROUP BY city""",
    ),
)
def _(spark, sf):
    calendar = rk.allergy_calendar(obs_daily(spark, sf), high=HIGH, moderate=MODERATE)
    return rk.safe_weeks(calendar, below=SAFE_BELOW)


HOURS = [*sql.MART_CHAIN[:-1], sql.obs_daily(), FLAGS]
ROLLING = """
rolling AS (
  SELECT city, date_local, max(m) AS ozone_8h_max FROM (
    SELECT city, date_local, avg(ozone) OVER (PARTITION BY city ORDER BY time_utc
      ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m FROM hourly)
  GROUP BY ALL
)"""
RISK = f"""
risk AS (
  SELECT city, date_local, pm2_5_avg, high_any, year, month, ozone_8h_max,
    ozone_8h_max > {OZONE} AS bad_ozone, pm2_5_avg > {PM25} AS bad_pm25,
    high_any AND (ozone_8h_max > {OZONE} OR pm2_5_avg > {PM25}) AS "both",
    CASE WHEN ozone_8h_max > {OZONE} THEN '{CAUSES[0]}' ELSE '{CAUSES[1]}' END AS cause
  FROM flags JOIN rolling USING (city, date_local)
)"""
RISK_CTES = [*HOURS, ROLLING, RISK]


def risk_of(spark, sf):
    return risk_from(spark, sf, obs_daily(spark, sf))


def risk_from(spark, sf, days):
    return rk.risk_days(
        days, hourly_mart(spark, sf), levels=HIGH, ozone_limit=OZONE, pm25_limit=PM25
    )


@register(
    "rolling8_daily_max",
    sql.query([*HOURS, ROLLING], "SELECT * FROM rolling", ["ozone_8h_max"]),
)
def _(spark, sf):
    return rk.rolling_daily_max(hourly_mart(spark, sf))


@register(
    "combined_risk_days",
    sql.query(RISK_CTES, "SELECT * FROM risk", ["ozone_8h_max", "pm2_5_avg"]),
)
def _(spark, sf):
    return risk_of(spark, sf)


@register(
    "risk_headline",
    sql.query(
        RISK_CTES,
        """SELECT count(*) FILTER (WHERE high_any) AS high_days,
             count(*) FILTER (WHERE bad_ozone OR bad_pm25) AS bad_air_days,
             count(*) FILTER (WHERE "both") AS both_days,
             count(*) FILTER (WHERE "both" AND bad_ozone) AS both_ozone,
             count(*) FILTER (WHERE "both" AND bad_pm25) AS both_pm25 FROM risk""",
    ),
)
def _(spark, sf):
    return rk.risk_headline(risk_of(spark, sf))


@register(
    "risk_by_year",
    sql.query(
        RISK_CTES,
        'SELECT year, sum("both"::INTEGER) / 5.0::DOUBLE AS risk_days FROM risk GROUP BY ALL',
        ["risk_days"],
    ),
)
def _(spark, sf):
    return rk.risk_by_year(risk_of(spark, sf), n_sites=5)


@register(
    "risk_by_site_year",
    sql.query(
        RISK_CTES,
        'SELECT city, year, sum("both"::INTEGER) AS "both" FROM risk GROUP BY ALL',
        longs=["both"],
    ),
)
def _(spark, sf):
    return rk.risk_by_site_year(risk_of(spark, sf))


@register(
    "risk_per_year",
    sql.query(
        RISK_CTES,
        'SELECT sum("both"::INTEGER)::DOUBLE / (count(DISTINCT year) * 5) AS risk_per_year FROM risk',
        ["risk_per_year"],
    ),
)
def _(spark, sf):
    return rk.risk_per_year(risk_of(spark, sf), n_sites=5)


@register(
    "risk_by_month_cause",
    sql.query(
        RISK_CTES,
        f"""SELECT m.month, count(cause) FILTER (WHERE cause = '{CAUSES[0]}') AS ozone,
              count(cause) FILTER (WHERE cause = '{CAUSES[1]}') AS pm2_5
            FROM (SELECT unnest(range(3, 10)) AS month) m
            LEFT JOIN (SELECT month, cause FROM risk WHERE "both") r ON r.month = m.month GROUP BY ALL""",
        ints=["month"],
    ),
)
def _(spark, sf):
    return rk.risk_by_month(risk_of(spark, sf)).toDF("month", "ozone", "pm2_5")
