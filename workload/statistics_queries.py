"""Correlations, season drivers, campaign triggers, validation, sample sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stationlake.model import MEASURED_COLUMNS, MEASURED_SEASONS, measured_seasons
from stationlake.plans import planning as pl
from stationlake.plans import statistics as st
from workload import sql
from workload.climatology_queries import SEASONS, days_and_seasons
from workload.fixtures import obs_daily, sites, table
from workload.planning_queries import INDEX
from workload.registry import register
from workload.weather_queries import season_days_of, season_days_sql

CAP = sql.capital()


def _ranks(columns, partition: str = "") -> str:
    return ", ".join(
        f"rank() OVER ({partition} ORDER BY {c}) + (count(*) OVER (PARTITION BY "
        f"{partition.replace('PARTITION BY', '') + ',' if partition else ''} {c}) - 1) / 2.0::DOUBLE AS \"r_{c}\""
        for c in columns
    )


PAIRS = [(a, b) for i, a in enumerate(st.CORRELATED) for b in st.CORRELATED[:i]]


@register(
    "spearman_matrix",
    sql.query(
        [
            *SEASONS,
            season_days_sql(["birch"]),
            f"ranked AS (SELECT {_ranks(st.CORRELATED)} FROM season_days)",
        ],
        " UNION ALL ".join(
            f"SELECT '{a}' AS var1, '{b}' AS var2, nullif(corr(r_{a}, r_{b}), 'nan'::DOUBLE) AS rho, count(*) AS n FROM ranked"
            for a, b in PAIRS
        ),
        ["rho"],
    ),
)
def _(spark, sf):
    return st.spearman_matrix(season_days_of(spark, sf, columns={"birch": "birch_pollen_avg"}))


DRIVERS = f"""
drivers AS (
  SELECT i.city, i.pollen_type, i.year, i.year_total, i.index, p.t AS prev_summer_temp,
    s.t AS spring_temp, w.season_temp, w.season_rain_days
  FROM intensity i
  LEFT JOIN (SELECT city, year(date_local) + 1 AS year, avg(temperature_avg_c) AS t FROM obs_daily
             WHERE month(date_local) IN (6, 7) GROUP BY ALL) p ON p.city = i.city AND p.year = i.year
  JOIN (SELECT city, year(date_local) AS year, avg(temperature_avg_c) AS t FROM obs_daily
        WHERE month(date_local) IN (3, 4, 5) GROUP BY ALL) s ON s.city = i.city AND s.year = i.year
  JOIN (SELECT d.city, {sql.capital("x.pollen_type")} AS pollen_type, x.year, avg(temperature_avg_c) AS season_temp,
          avg((precipitation_mm >= 1)::INTEGER) AS season_rain_days
        FROM obs_daily d JOIN seasons x ON x.city = d.city AND x.year = year(d.date_local)
          AND d.date_local BETWEEN x.season_start AND x.season_end
        GROUP BY ALL) w ON w.city = i.city AND w.pollen_type = i.pollen_type AND w.year = i.year
)"""
DRIVER_FLOATS = ["year_total", "index", *st.DRIVERS]


def drivers_of(spark, sf):
    days, seasons = days_and_seasons(spark, sf)
    return st.season_drivers(pl.intensity(seasons), days, seasons)


@register(
    "season_drivers", sql.query([*SEASONS, INDEX, DRIVERS], "SELECT * FROM drivers", DRIVER_FLOATS)
)
def _(spark, sf):
    return drivers_of(spark, sf)


def _by_species(driver: str) -> str:
    ranked = f"SELECT pollen_type, {_ranks(['index', driver], 'PARTITION BY pollen_type')} FROM drivers WHERE {driver} IS NOT NULL"
    return f"""SELECT pollen_type, '{driver}' AS driver, nullif(corr(r_index, r_{driver}), 'nan'::DOUBLE) AS rho, count(*) AS n
               FROM ({ranked}) GROUP BY ALL"""


@register(
    "spearman_by_species",
    sql.query(
        [*SEASONS, INDEX, DRIVERS],
        " UNION ALL ".join(_by_species(d) for d in st.DRIVERS),
        ["rho"],
    ),
)
def _(spark, sf):
    return st.spearman_by_species(drivers_of(spark, sf))


LEVEL = 30.0
TRIGGER = f"""
hits AS (
  SELECT city, year(date_local)::INTEGER AS year, date_local,
    sum((birch_pollen_avg > {LEVEL})::INTEGER) OVER (PARTITION BY city, year(date_local) ORDER BY date_local
      ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS above
  FROM obs_daily WHERE month(date_local) >= 2
),
triggers AS (
  SELECT city, year, (min(date_local) FILTER (WHERE above = 3) - 2)::DATE AS trigger FROM hits GROUP BY ALL
)"""


def triggers_of(spark, sf):
    return st.campaign_trigger(obs_daily(spark, sf), level=LEVEL)


@register(
    "campaign_trigger",
    sql.query([sql.SITE_LINES, sql.obs_daily(), TRIGGER], "SELECT * FROM triggers"),
)
def _(spark, sf):
    return triggers_of(spark, sf)


def comparison_of(spark, sf):
    days, seasons = days_and_seasons(spark, sf)
    return st.trigger_vs_fixed(st.campaign_trigger(days, level=LEVEL), seasons)


COMPARE = """
timing AS (
  SELECT t.city, t.year, date_diff('day', season_start, trigger) AS a,
    date_diff('day', season_start, make_date(t.year, 4, 1)) AS b
  FROM triggers t JOIN seasons s ON s.city = t.city AND s.year = t.year AND s.pollen_type = 'birch'
),
compared AS (
  SELECT city, year, 'Pollen trigger' AS campaign_start, a AS days_vs_season FROM timing
  UNION ALL SELECT city, year, 'Fixed date (1 April)', b FROM timing
)"""


@register(
    "trigger_vs_fixed",
    sql.query([*SEASONS, TRIGGER, COMPARE], "SELECT * FROM compared", ints=["days_vs_season"]),
)
def _(spark, sf):
    return comparison_of(spark, sf)


@register(
    "trigger_summary",
    sql.query(
        [*SEASONS, TRIGGER, COMPARE],
        """SELECT campaign_start, city, median(days_vs_season)::DOUBLE AS median_days
           FROM compared GROUP BY ALL""",
        ["median_days"],
    ),
)
def _(spark, sf):
    return st.trigger_summary(comparison_of(spark, sf))


MEASURED = "measured({}) AS (VALUES {})".format(
    ", ".join(f'"{c}"' for c in MEASURED_COLUMNS), ", ".join(str(r) for r in MEASURED_SEASONS)
)
MODEL = f"""
model AS (
  SELECT {CAP} AS pollen_type, avg(dayofyear(season_start)) AS s, avg(dayofyear(peak_date)) AS p,
    avg(dayofyear(season_end)) AS e, avg(year_total) AS t
  FROM seasons WHERE city = 'EUROPE' GROUP BY ALL
),
adjusted AS (
  SELECT pollen_type, {", ".join(f'"{c}"::DOUBLE + "{c}_trend"::DOUBLE * (2023 - (first_year + last_year) / 2.0::DOUBLE) AS m_{c}' for c in ("start", "peak", "end", "spin"))}
  FROM measured
)"""


def _doy(expr: str) -> str:
    return f"(make_date(2023, 1, 1) + (round_even({expr}, 0)::INTEGER - 1))::DATE"


@register(
    "trend_validation",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily(), sql.seasons(lo=0.03, hi=0.97), MEASURED, MODEL],
        "SELECT pollen_type, "
        + ", ".join(
            f"{_doy(f'm_{c}')} AS {c}_measured, {_doy(m)} AS {c}_model, "
            f"round_even({m} - m_{c}, 0)::INTEGER AS {c}_diff_days"
            for c, m in (("start", "s"), ("peak", "p"), ("end", "e"))
        )
        + ", round_even(t / m_spin, 2) AS amount_ratio FROM model JOIN adjusted USING (pollen_type)",
        ["amount_ratio"],
    ),
)
def _(spark, sf):
    return st.model_vs_measured(
        st.model_seasons(obs_daily(spark, sf), "EUROPE"), measured_seasons(spark)
    )


@register(
    "sample_size",
    sql.query(
        [
            """units AS (
              SELECT r_name AS region, c_custkey,
                coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) >= 1998), 0) AS sales,
                coalesce(sum(o_totalprice) FILTER (WHERE year(o_orderdate) < 1998), 0) AS before
              FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
              GROUP BY ALL)""",
            """stats AS (SELECT region, stddev_samp(sales) / avg(sales) AS cv, corr(sales, before) AS rho
                 FROM units GROUP BY ALL)""",
        ],
        """SELECT region, lift, cv, rho,
             round_even(2 * pow(1.96 + 0.84, 2) * cv * cv / (lift * lift), 0) AS per_group,
             round_even(2 * pow(1.96 + 0.84, 2) * cv * cv * (1 - rho * rho) / (lift * lift), 0) AS per_group_adjusted
           FROM stats, (SELECT unnest([0.03, 0.05, 0.1, 0.15])::DOUBLE AS lift)""",
        ["lift", "cv", "rho"],
        longs=["per_group", "per_group_adjusted"],
    ),
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    later = F.year("o_orderdate") >= 1998
    price, none = F.col("o_totalprice"), F.lit(0.0)
    units = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(sites(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("region"), "c_custkey")
        .agg(
            F.coalesce(F.sum(F.when(later, price)), none).alias("sales"),
            F.coalesce(F.sum(F.when(~later, price)), none).alias("before"),
        )
    )
    return st.sample_size(units, ["region"], "sales", "before")
