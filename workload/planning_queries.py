"""Stock, travel, event and retail planning."""

from __future__ import annotations

from stationlake.model import FACTOR_AIR, FACTOR_HOT, FACTOR_RAIN
from stationlake.plans import planning as pl
from workload import sql
from workload.climatology_queries import SEASONS, seasons_of
from workload.fixtures import MODERATE, obs_daily, regions_of, stored
from workload.registry import register
from workload.risk_queries import DAYS, FLAGS, RISK_CTES, flags_of, risk_from

CAP = sql.capital()
WEEKS = ["earliest_start", "typical_start", "typical_peak", "typical_end", "yearly_pollen"]

PLAN = f"""
plan AS (
  SELECT *, round_even(earliest_start - 1, 0)::INTEGER AS stock_ready_week FROM (
    SELECT {CAP} AS pollen_type, city, quantile_cont(start_week::DOUBLE, 0.1) AS earliest_start,
      median(start_week)::DOUBLE AS typical_start, median(peak_week)::DOUBLE AS typical_peak,
      median(end_week)::DOUBLE AS typical_end, avg(year_total) AS yearly_pollen
    FROM seasons GROUP BY ALL)
)"""
GAPS = f"""
gaps AS (
  SELECT {sql.capital("s.pollen_type")} AS pollen_type, s.city, median(gap) AS median, min(gap) AS earliest, max(gap) AS latest
  FROM (SELECT a.pollen_type, a.city, date_diff('day', b.season_start, a.season_start) / 7.0::DOUBLE AS gap
        FROM seasons a JOIN seasons b
          ON b.city = 'AFRICA' AND a.pollen_type = b.pollen_type AND a.year = b.year) s
  GROUP BY ALL
)"""


@register("stock_plan", sql.query([*SEASONS, PLAN], "SELECT * FROM plan", WEEKS))
def stock_plan(spark, sf):
    return pl.stock_plan(seasons_of(spark, sf))


@register(
    "stock_headline",
    sql.query(
        [*SEASONS, PLAN, GAPS],
        """SELECT pollen_type, first_city, first_ready_week, yearly_pollen, typical_peak, largest_gap
           FROM (SELECT pollen_type, avg(yearly_pollen) AS yearly_pollen,
                   median(typical_peak) AS typical_peak FROM plan GROUP BY ALL)
           JOIN (SELECT pollen_type, city AS first_city, stock_ready_week AS first_ready_week FROM plan
                 QUALIFY row_number() OVER (PARTITION BY pollen_type ORDER BY stock_ready_week, city) = 1)
             USING (pollen_type)
           JOIN (SELECT pollen_type, max(median) AS largest_gap FROM gaps GROUP BY ALL) USING (pollen_type)""",
        ["yearly_pollen", "typical_peak", "largest_gap"],
    ),
)
def _(spark, sf):
    seasons = seasons_of(spark, sf)
    return pl.stock_headline(pl.stock_plan(seasons), pl.start_gaps(seasons, "AFRICA"))


@register(
    "weak_data_label",
    sql.query(
        [*SEASONS, PLAN],
        """SELECT pollen_type, city, CASE WHEN pollen_type = 'Alder' AND city = 'ASIA' THEN 'ok'
             WHEN pollen_type IN ('Birch', 'Grass') THEN 'good' ELSE 'weak' END AS data_quality FROM plan""",
    ),
)
def _(spark, sf):
    labelled = pl.data_quality(
        pl.stock_plan(seasons_of(spark, sf)), exceptions={("Alder", "ASIA"): "ok"}
    )
    return labelled.select("pollen_type", "city", "data_quality")


@register(
    "season_coverage",
    sql.query(
        SEASONS,
        f"""SELECT {CAP} AS pollen_type, city, w AS week,
              avg((w BETWEEN start_week AND end_week)::INTEGER) AS in_season
            FROM seasons, (SELECT unnest(range(5, 37)) AS w) GROUP BY ALL""",
        ["in_season"],
        ["week"],
    ),
)
def _(spark, sf):
    return pl.season_coverage(seasons_of(spark, sf))


@register("start_gaps", sql.query([*SEASONS, GAPS], "SELECT * FROM gaps", ["median", "earliest", "latest"]))
def _(spark, sf):
    return pl.start_gaps(seasons_of(spark, sf), "AFRICA")


NATION = [sql.SITE_LINES, sql.obs_daily("n_name"), sql.seasons()]
REGIONAL = """
mean_start AS (
  SELECT year, r_name AS region, avg(date_diff('day', DATE '1970-01-01', season_start)) AS d
  FROM seasons JOIN nation ON n_name = city JOIN region ON r_regionkey = n_regionkey
  WHERE pollen_type = 'birch' GROUP BY ALL
),
regional AS (
  SELECT year, floor(max(d) FILTER (WHERE region = 'EUROPE')
    - max(d) FILTER (WHERE region = 'AFRICA'))::INTEGER AS gap_days FROM mean_start GROUP BY ALL
)"""


def regional_of(spark, sf):
    return pl.regional_gap(
        seasons_of(spark, sf, "n_name"), regions_of(spark, sf), early="AFRICA", late="EUROPE"
    )


@register(
    "regional_gap",
    sql.query(
        [*NATION, REGIONAL],
        "SELECT year, gap_days, round(gap_days / 7.0::DOUBLE, 1) AS gap_weeks FROM regional",
        ["gap_weeks"],
    ),
)
def _(spark, sf):
    return regional_of(spark, sf)


@register(
    "regional_gap_summary",
    sql.query(
        [*NATION, REGIONAL],
        """SELECT median(gap_days)::DOUBLE AS median_days, min(gap_days) AS min_days,
             max(gap_days) AS max_days FROM regional""",
        ["median_days"],
    ),
)
def _(spark, sf):
    return pl.regional_gap_summary(regional_of(spark, sf))


INDEX = f"""
intensity AS (
  SELECT city, {CAP} AS pollen_type, year, year_total,
    year_total / nullif(avg(year_total) OVER (PARTITION BY city, pollen_type), 0) * 100 AS index
  FROM seasons
)"""


@register("intensity_index", sql.query([*SEASONS, INDEX], "SELECT * FROM intensity", ["year_total", "index"]))
def _(spark, sf):
    return pl.intensity(seasons_of(spark, sf))


@register(
    "mean_intensity",
    sql.query(
        [*SEASONS, INDEX],
        "SELECT pollen_type, year, avg(index) AS index FROM intensity GROUP BY ALL",
        ["index"],
    ),
)
def _(spark, sf):
    return pl.mean_intensity(pl.intensity(seasons_of(spark, sf)))


HALVES = """
halves AS (
  SELECT city, strftime(date_local, '%b') || CASE WHEN day(date_local) <= 15 THEN ' 1–15' ELSE ' 16–end' END AS period,
    avg(high_any::INTEGER) AS high_any FROM flags WHERE month IN (4, 5, 6) GROUP BY ALL
)"""


@register("half_month_share", sql.query([*DAYS, FLAGS, HALVES], "SELECT * FROM halves", ["high_any"]))
def _(spark, sf):
    return pl.half_month_share(flags_of(spark, sf))


@register(
    "best_site_per_period",
    sql.query(
        [*DAYS, FLAGS, HALVES],
        """SELECT period, city, high_any FROM halves
           QUALIFY row_number() OVER (PARTITION BY period ORDER BY high_any, city) = 1""",
        ["high_any"],
    ),
)
def _(spark, sf):
    return pl.best_site_per_period(pl.half_month_share(flags_of(spark, sf)))


@register(
    "spring_share",
    sql.query(
        [*DAYS, FLAGS],
        "SELECT city, avg(high_any::INTEGER) AS high_any FROM flags WHERE month IN (4, 5, 6) GROUP BY ALL",
        ["high_any"],
    ),
)
def _(spark, sf):
    return pl.spring_share(flags_of(spark, sf))


EVENT_DAYS = f"""
event_days AS (
  SELECT d.city, d.date_local, week(d.date_local)::INTEGER AS week, {sql.any_above(MODERATE, "d.")} AS pollen,
    d.precipitation_mm >= 1 AS rain, d.temperature_max_c >= 25 AS hot, r.bad_ozone OR r.bad_pm25 AS bad_air,
    {sql.any_above(MODERATE, "d.")} OR d.precipitation_mm >= 1 OR r.bad_ozone OR r.bad_pm25 AS problem
  FROM obs_daily d JOIN risk r ON r.city = d.city AND r.date_local = d.date_local
  WHERE week(d.date_local) BETWEEN 14 AND 38
)"""
EVENT_CTES = [*RISK_CTES, EVENT_DAYS]
FACTORS = {"rain": FACTOR_RAIN, "bad_air": FACTOR_AIR, "hot": FACTOR_HOT}
POOLED = " UNION ALL ".join(
    f"SELECT week, '{label}' AS factor, avg({c}::INTEGER) AS share FROM event_days GROUP BY ALL"
    for c, label in FACTORS.items()
)
SITE_MEAN = " UNION ALL ".join(
    f"""SELECT week, '{label}' AS factor, avg(s) AS share FROM
          (SELECT city, week, avg({c}::INTEGER) AS s FROM event_days GROUP BY ALL) GROUP BY ALL"""
    for c, label in FACTORS.items()
)
EVENT_RISK = "event_risk AS (SELECT city, week, avg(problem::INTEGER) AS problem FROM event_days GROUP BY ALL)"


def event_days_of(spark, sf):
    days = stored(obs_daily(spark, sf), "days")
    return pl.event_days(days, risk_from(spark, sf, days), level=MODERATE)


@register("event_factors_pooled", sql.query(EVENT_CTES, POOLED, ["share"]))
def _(spark, sf):
    return pl.event_factors(event_days_of(spark, sf))


@register("event_factors_site_mean", sql.query(EVENT_CTES, SITE_MEAN, ["share"]))
def _(spark, sf):
    return pl.event_factors_site_mean(event_days_of(spark, sf))


@register("event_risk", sql.query([*EVENT_CTES, EVENT_RISK], "SELECT * FROM event_risk", ["problem"]))
def _(spark, sf):
    return pl.event_risk(event_days_of(spark, sf))


@register(
    "best_and_worst_week",
    sql.query(
        [
            *EVENT_CTES,
            EVENT_RISK,
            "weeks AS (SELECT week, avg(problem) AS problem FROM event_risk GROUP BY ALL)",
        ],
        """SELECT b.week AS best_week, b.problem AS best_share, w.week AS worst_week, w.problem AS worst_share
           FROM (SELECT * FROM weeks WHERE week BETWEEN 18 AND 35 ORDER BY round(problem, 9), week LIMIT 1) b,
                (SELECT * FROM weeks WHERE week BETWEEN 14 AND 35 ORDER BY round(problem, 9) DESC, week LIMIT 1) w""",
        ["best_share", "worst_share"],
    ),
)
def _(spark, sf):
    return pl.best_and_worst_week(pl.event_risk(event_days_of(spark, sf)))


@register(
    "best_weeks_top3",
    sql.query(
        [*EVENT_CTES, EVENT_RISK],
        """SELECT city, week, problem, row_number() OVER (PARTITION BY city ORDER BY problem, week) AS rank
           FROM event_risk WHERE week BETWEEN 18 AND 35
           QUALIFY row_number() OVER (PARTITION BY city ORDER BY problem, week) <= 3""",
        ["problem"],
        ["rank"],
    ),
)
def _(spark, sf):
    return pl.best_weeks(pl.event_risk(event_days_of(spark, sf)))


NEED = """
need AS (
  SELECT city, month, avg(high_any::INTEGER) AS high_any, avg((pm2_5_avg > 7)::INTEGER) AS bad_pm25,
    avg(high_any::INTEGER) * 30.4::DOUBLE AS high_days, avg((pm2_5_avg > 7)::INTEGER) * 30.4::DOUBLE AS pm25_days
  FROM flags GROUP BY ALL
)"""


@register(
    "days_per_month",
    sql.query([*DAYS, FLAGS, NEED], "SELECT * FROM need", ["high_any", "bad_pm25", "high_days", "pm25_days"]),
)
def _(spark, sf):
    return pl.retail_need(flags_of(spark, sf), pm25_limit=7.0)


@register(
    "peak_month",
    sql.query(
        [*DAYS, FLAGS, NEED],
        """SELECT
             (SELECT month FROM need GROUP BY month ORDER BY avg(high_days) DESC, month LIMIT 1) AS peak_month,
             (SELECT month FROM need GROUP BY month ORDER BY avg(pm25_days) DESC, month LIMIT 1) AS pm25_month,
             (SELECT city FROM need GROUP BY city ORDER BY sum(pm25_days) DESC, city LIMIT 1) AS pm25_city""",
    ),
)
def _(spark, sf):
    return pl.retail_headline(pl.retail_need(flags_of(spark, sf), pm25_limit=7.0))


@register(
    "pm25_days_per_year",
    sql.query(
        DAYS,
        """SELECT city, round(avg((pm2_5_avg > 7)::INTEGER) * 365, 1) AS days_per_year
           FROM obs_daily GROUP BY ALL""",
        ["days_per_year"],
    ),
)
def _(spark, sf):
    return pl.pm25_days_per_year(obs_daily(spark, sf), pm25_limit=7.0)


SOUTH_TO_NORTH = ["AFRICA", "MIDDLE EAST", "ASIA", "AMERICA", "EUROPE"]


@register(
    "season_grid",
    sql.query(
        SEASONS,
        "SELECT pollen_type, year, "
        + ", ".join(f"""max(season_days) FILTER (WHERE city = '{c}') AS "{c}\"""" for c in SOUTH_TO_NORTH)
        + " FROM seasons GROUP BY pollen_type, year",
        ints=["year", *SOUTH_TO_NORTH],
    ),
)
def _(spark, sf):
    """Length of the seasons, sites side by side in a fixed order."""
    return pl.season_grid(seasons_of(spark, sf), SOUTH_TO_NORTH)
