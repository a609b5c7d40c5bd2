"""Data rules, reports and column profiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stationlake.model import daily_columns
from stationlake.operators.reshape import unpivot
from stationlake.plans import marts
from stationlake.plans import profiles as pr
from stationlake.plans import quality as qu
from workload import mart_queries as mq
from workload import sql
from workload.fixtures import obs_daily, raw_air, raw_weather, stored, table
from workload.registry import register

RAW = [sql.SITE_LINES, sql.RAW_AIR, sql.RAW_WEATHER]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]


@register(
    "dq_unique",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def _(spark, sf):
    return qu.unique_combination(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register(
    "dq_range",
    sql.query(
        [*RAW, sql.STG_WEATHER],
        "SELECT * FROM stg_weather WHERE temperature_c < -50 OR temperature_c > 40",
    ),
)
def _(spark, sf):
    staged = marts.stage_weather(raw_weather(spark, sf))
    return qu.in_range(staged, "temperature_c", -50.0, 40.0)


@register("dq_not_negative", "SELECT * FROM customer WHERE c_acctbal < 0")
def _(spark, sf):
    return qu.not_negative(table(spark, sf, "customer"), "c_acctbal")


@register("dq_not_null", sql.query(RAW, "SELECT * FROM raw_air WHERE alder_pollen IS NULL"))
def _(spark, sf):
    return qu.not_null(raw_air(spark, sf), "alder_pollen")


@register(
    "dq_accepted_values",
    "SELECT n_name AS city, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey "
    "WHERE r_name NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')",
)
def _(spark, sf):
    from workload.fixtures import regions_of

    return qu.accepted_values(regions_of(spark, sf), "region", REGIONS)


MISSING_DAYS = """
missing_days AS (
  SELECT b.city, d::DATE AS date_local
  FROM (SELECT city, unnest(generate_series(min(date_local), max(date_local), INTERVAL 1 DAY)) AS d
        FROM obs_daily GROUP BY city) b
  WHERE NOT EXISTS (SELECT 1 FROM obs_daily o WHERE o.city = b.city AND o.date_local = b.d::DATE)
)"""


@register(
    "dq_missing_days",
    sql.query([sql.SITE_LINES, sql.obs_daily("n_name"), MISSING_DAYS], "SELECT * FROM missing_days"),
)
def _(spark, sf):
    return qu.missing_days(obs_daily(spark, sf, "n_name"))


@register(
    "dq_missing_hours",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT city, count(*) AS n_hours, date_diff('hour', min(time), max(time)) + 1 AS expected_hours
           FROM event_hours GROUP BY city
           HAVING count(*) <> date_diff('hour', min(time), max(time)) + 1""",
    ),
)
def _(spark, sf):
    from workload.fixtures import event_hours

    return qu.missing_hours(event_hours(spark, sf), "time")


@register(
    "hour_counts",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT city, min(time) AS first_hour, max(time) AS last_hour, count(*) AS n_hours,
             date_diff('hour', min(time), max(time)) + 1 AS expected_hours FROM event_hours GROUP BY city""",
    ),
)
def _(spark, sf):
    from workload.fixtures import event_hours

    return qu.hour_counts(event_hours(spark, sf), "time")


@register(
    "dq_season_order",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily(), sql.seasons()],
        """SELECT city, pollen_type, year FROM seasons
           WHERE season_start > CASE WHEN year % 2 = 0 THEN peak_date - 60 ELSE season_end END""",
    ),
)
def _(spark, sf):
    """Seasons whose end is damaged in every second year: 60 days before the peak."""
    seasons = marts.seasons(obs_daily(spark, sf))
    damaged = F.when(F.col("year") % 2 == 0, F.date_sub("peak_date", 60)).otherwise(F.col("season_end"))
    broken = qu.disordered_seasons(seasons.withColumn("season_end", damaged))
    return broken.select("city", "pollen_type", "year")


def _age(name: str) -> str:
    return f"""SELECT '{name}' AS source, max(time) AS newest,
      CASE WHEN date_diff('second', max(time), TIMESTAMP '2001-11-07') > 4 * 86400 THEN 'error'
           WHEN date_diff('second', max(time), TIMESTAMP '2001-11-07') > 2 * 86400 THEN 'warn'
           ELSE 'pass' END AS status FROM raw_{'air' if name == 'air_quality' else 'weather'}"""


@register("dq_freshness", sql.query(RAW, f"{_age('air_quality')} UNION ALL {_age('weather')}"))
def _(spark, sf):
    now = F.lit(datetime(2001, 11, 7)).cast("timestamp_ntz")
    return qu.freshness(
        {"air_quality": raw_air(spark, sf), "weather": raw_weather(spark, sf)}, now
    )


@register(
    "missing_report",
    sql.query(
        [*RAW, f"missing AS ({mq.MISSING})"],
        """SELECT source, variable, year, round(avg(pct_missing), 1) AS pct_missing
           FROM missing WHERE pct_missing > 0 GROUP BY ALL""",
        ["pct_missing"],
        ["year"],
    ),
)
def _(spark, sf):
    return qu.missing_report(mq.missing(spark, sf))


@register(
    "missing_share_by_site",
    sql.query(
        RAW,
        "SELECT city, "
        + ", ".join(f"round(100 * (1 - count({v}) / count(*)), 1) AS {v}" for v in mq.AIR)
        + " FROM raw_air GROUP BY city",
        mq.AIR,
    ),
)
def _(spark, sf):
    return pr.missing_share(raw_air(spark, sf), ["city"], mq.AIR, digits=1, percent=True)


@register(
    "missing_share_by_year",
    sql.query(
        RAW,
        "SELECT year(time) AS year, "
        + ", ".join(f"round(100 * (1 - count({v}) / count(*)), 1) AS {v}" for v in mq.VARIABLES)
        + " FROM raw_air GROUP BY year(time)",
        mq.VARIABLES,
        ["year"],
    ),
)
def _(spark, sf):
    raw = raw_air(spark, sf).withColumn("year", F.year("time"))
    return pr.missing_share(raw, ["year"], pr.matching(raw, ".*_pollen"), digits=1, percent=True)


# --- the whole rule set of the mart chain ------------------------------------

SITES = [*REGIONS, "MIDDLE EAST"]
SPECIES = list(sql.SPECIES)
CHAIN = [*sql.MART_CHAIN, sql.weekly("daily"), sql.seasons("daily")]


def _doubles(name: str, view: str, columns: list[str]) -> str:
    keys = ", ".join(columns)
    return f"""SELECT '{name}' AS "table", 'unique({keys})' AS rule, count(*) AS violations
      FROM (SELECT {keys} FROM {view} GROUP BY ALL HAVING count(*) > 1)"""


def _broken(name: str, view: str, rule: str, condition: str) -> str:
    return f"""SELECT '{name}' AS "table", '{rule}' AS rule,
      count(*) FILTER (WHERE {condition}) AS violations FROM {view}"""


def _null(name, view, c):
    return _broken(name, view, f"not_null({c})", f"{c} IS NULL")


def _negative(name, view, c):
    return _broken(name, view, f"not_negative({c})", f"{c} < 0")


def _range(name, view, c, lo, hi):
    return _broken(name, view, f"in_range({c}, {lo}, {hi})", f"{c} < {lo} OR {c} > {hi}")


def _among(name, view, c, values):
    return _broken(name, view, f"accepted_values({c})", f"{c} NOT IN ({', '.join(repr(v) for v in values)})")


_AIR = [f"{s}_pollen" for s in SPECIES] + ["pm2_5", "pm10", "ozone", "no2"]
SUITE = " UNION ALL ".join(
    [
        _doubles("air_quality", "raw_air", ["city", "time"]),
        _doubles("weather", "raw_weather", ["city", "time"]),
        _doubles("stg_air_quality", "stg_air", ["city", "time_utc"]),
        *[_null("stg_air_quality", "stg_air", c) for c in ["city", "time_utc", "time_local", *_AIR]],
        *[_negative("stg_air_quality", "stg_air", c) for c in _AIR],
        _among("stg_air_quality", "stg_air", "city", SITES),
        _doubles("stg_weather", "stg_weather", ["city", "time_utc"]),
        *[
            _null("stg_weather", "stg_weather", c)
            for c in [
                "city", "time_utc", "temperature_c", "humidity_pct", "precipitation_mm",
                "wind_speed_kmh", "wind_direction_deg",
            ]
        ],
        _range("stg_weather", "stg_weather", "temperature_c", -50, 40),
        _range("stg_weather", "stg_weather", "humidity_pct", 0, 100),
        _range("stg_weather", "stg_weather", "wind_direction_deg", 0, 360),
        _negative("stg_weather", "stg_weather", "precipitation_mm"),
        _negative("stg_weather", "stg_weather", "wind_speed_kmh"),
        _doubles("hourly", "hourly", ["city", "time_utc"]),
        _range("hourly", "hourly", "hour_local", 0, 23),
        _null("hourly", "hourly", "temperature_c"),
        _doubles("daily", "daily", ["city", "date_local"]),
        _range("daily", "daily", "n_hours", 4, 6),
        _doubles("weekly", "weekly", ["city", "iso_year", "iso_week"]),
        _range("weekly", "weekly", "n_days", 1, 7),
        _doubles("seasons", "seasons", ["city", "pollen_type", "year"]),
        _among("seasons", "seasons", "pollen_type", SPECIES),
        *[_null("seasons", "seasons", c) for c in ["season_start", "peak_date", "season_end"]],
        """SELECT 'daily', 'no_missing_days', count(*) FROM (
             SELECT b.city, b.d FROM (SELECT city, unnest(generate_series(min(date_local), max(date_local),
               INTERVAL 1 DAY)) AS d FROM daily GROUP BY city) b
             WHERE NOT EXISTS (SELECT 1 FROM daily o WHERE o.city = b.city AND o.date_local = b.d::DATE))""",
        """SELECT 'hourly', 'no_missing_hours', count(*) FROM (
             SELECT city FROM hourly GROUP BY city
             HAVING count(*) <> date_diff('hour', min(time_utc), max(time_utc)) + 1)""",
        "SELECT 'seasons', 'start_not_after_end', count(*) FILTER (WHERE season_start > season_end) FROM seasons",
    ]
)


@register("dq_suite", sql.query(CHAIN, SUITE))
def _(spark, sf):
    # Each is used by the next one and by rules of its own.
    air, weather = stored(raw_air(spark, sf), "air"), stored(raw_weather(spark, sf), "weather")
    staged_air, staged_weather = marts.stage_air_quality(air), marts.stage_weather(weather)
    hours = stored(marts.hourly(staged_air, staged_weather), "hours")
    days = stored(marts.daily(hours, min_hours=4), "days")
    tables = {
        "air_quality": air,
        "weather": weather,
        "stg_air_quality": staged_air,
        "stg_weather": staged_weather,
        "hourly": hours,
        "daily": days,
        "weekly": marts.weekly(days),
        "seasons": marts.seasons(days),
    }
    return qu.run_suite(tables, qu.rule_sets(sites=SITES, hours_per_day=(4, 6)))


# --- profiles ----------------------------------------------------------------

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


PROFILE_SQL = sql.query(
    [],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS min, max({c}) AS max, avg({c}) AS avg,
              count({c}) AS n_values, count(*) - count({c}) AS n_missing, median({c}) AS q50 FROM lineitem"""
        for c in PROFILED
    ),
    ["min", "max", "avg", "q50"],
)


@register("profile_columns", PROFILE_SQL)
def _(spark, sf):
    return pr.column_profile(table(spark, sf, "lineitem"), PROFILED)


@register("profile_columns_rescan", PROFILE_SQL)
def _(spark, sf):
    """The same by selection: the table is scanned three times and no value shuffled."""
    return pr.column_profile(table(spark, sf, "lineitem"), PROFILED, rescan=True)


@register(
    "describe_percentiles",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily(), f"long AS ({sql.long_daily()})"],
        """SELECT pollen_type, count(pollen) AS count, avg(pollen) AS mean, stddev_samp(pollen) AS std,
             min(pollen) AS min, max(pollen) AS max, quantile_cont(pollen, 0.5) AS p50,
             quantile_cont(pollen, 0.75) AS p75, quantile_cont(pollen, 0.9) AS p90,
             quantile_cont(pollen, 0.99) AS p99 FROM
               (SELECT pollen_type, pollen FROM long WHERE pollen >= 1 UNION ALL SELECT NULL, pollen FROM long
                UNION ALL SELECT 'none', NULL FROM long) GROUP BY ALL""",
        ["mean", "std", "min", "max", "p50", "p75", "p90", "p99"],
    ),
)
def _(spark, sf):
    long = unpivot(
        obs_daily(spark, sf), ["city", "date_local"], daily_columns(), "pollen_type", "pollen", True
    )
    # Beside the species a group without name, and one without values.
    listed = long.filter("pollen >= 1").select("pollen_type", "pollen")
    nameless = long.select(F.lit(None).cast("string").alias("pollen_type"), "pollen")
    empty = long.select(F.lit("none").alias("pollen_type"), F.lit(None).cast("double").alias("pollen"))
    return pr.describe(listed.unionByName(nameless).unionByName(empty), ["pollen_type"], "pollen")


@register(
    "first_valid",
    sql.query(
        RAW,
        " UNION ALL ".join(
            f"SELECT '{c}' AS variable, min(time) FILTER (WHERE {c} IS NOT NULL) AS first_valid FROM raw_air"
            for c in mq.VARIABLES
        ),
    ),
)
def _(spark, sf):
    return pr.first_valid(raw_air(spark, sf), "time", mq.VARIABLES)


@register("distinct_sites", sql.query(RAW, "SELECT DISTINCT city FROM raw_weather"))
def _(spark, sf):
    return pr.distinct_values(raw_weather(spark, sf), "city")
