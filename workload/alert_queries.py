"""Season and forecast alerts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from stationlake.plans import alerts as al
from workload import sql
from workload.climatology_queries import FORECAST, POLLEN, SEASONS, forecast_of, seasons_of
from workload.registry import register

AS_OF = date(2000, 1, 10)
EARLIER = date(2000, 1, 5)
LEVEL = 200.0
CAP = sql.capital()


def _doy(expr: str, year: int) -> str:
    return f"(make_date({year}, 1, 1) + (round_even({expr}, 0)::INTEGER - 1))::DATE"


def _coming(name: str, day: date) -> str:
    y, d = day.year, f"DATE '{day}'"
    return f"""
{name} AS (
  SELECT 'coming' AS kind, city, {CAP} AS pollen_type,
    date_diff('day', {d}, {_doy("median(dayofyear(season_start))", y)})::INTEGER AS days,
    {_doy("median(dayofyear(season_start))", y)} AS start,
    {_doy("min(dayofyear(season_start))", y)} AS earliest, {_doy("max(dayofyear(season_start))", y)} AS latest,
    min(year) AS first_year, max(year) AS last_year
  FROM seasons GROUP BY city, pollen_type
  HAVING date_diff('day', {d}, {_doy("median(dayofyear(season_start))", y)}) BETWEEN 1 AND 14
)"""


COMING = _coming("coming", AS_OF)
ACTIVE_ON = date(2000, 1, 24)
ACTIVE = f"""
active AS (
  SELECT city, pollen_type, {_doy("start_doy", 2000)} AS start, {_doy("end_doy", 2000)} AS "end" FROM typical
  WHERE DATE '{ACTIVE_ON}' BETWEEN {_doy("start_doy", 2000)} AND {_doy("end_doy", 2000)}
)"""
FUTURE = " UNION ALL ".join(
    f"SELECT city, '{c.removesuffix('_pollen').capitalize()}' AS pollen_type, time, coalesce({c}, 0) AS v "
    'FROM forecast WHERE time >= "current_time"'
    for c in POLLEN
)
FOUND = f"""
future AS ({FUTURE}),
marked AS (
  SELECT *, sum((v >= {LEVEL})::INTEGER) OVER w AS hit, lag(time, 2) OVER w AS run_start
  FROM future WINDOW w AS (PARTITION BY city, pollen_type ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
),
found AS (
  SELECT 'forecast' AS kind, city, pollen_type, min(run_start) FILTER (WHERE hit = 3) AS from_time, max(v) AS peak
  FROM marked GROUP BY city, pollen_type HAVING count(*) FILTER (WHERE hit = 3) > 0
)"""
FORECAST_CTES = [sql.EVENT_HOURS, sql.SNAPSHOTS, FORECAST, FOUND]


@register("coming_alerts", sql.query([*SEASONS, COMING], "SELECT * FROM coming"))
def _(spark, sf):
    return al.coming_alerts(seasons_of(spark, sf), AS_OF)


@register("in_season", sql.query([*SEASONS, sql.TYPICAL, ACTIVE], "SELECT * FROM active"))
def _(spark, sf):
    return al.in_typical_season(seasons_of(spark, sf), ACTIVE_ON)


@register("persistence_alerts", sql.query(FORECAST_CTES, "SELECT * FROM found", ["peak"]))
def _(spark, sf):
    return al.forecast_alerts(forecast_of(spark, sf), level=LEVEL)


ALL_ALERTS = """
SELECT kind, city, pollen_type, days, start, earliest, latest, first_year, last_year,
  NULL::TIMESTAMP AS from_time, NULL::DOUBLE AS peak FROM coming
UNION ALL SELECT kind, city, pollen_type, NULL, NULL, NULL, NULL, NULL, NULL, from_time, peak FROM found
"""
ALL_CTES = [*SEASONS, COMING, *FORECAST_CTES]


def alerts_of(spark, sf):
    return al.check(seasons_of(spark, sf), AS_OF, forecast_of(spark, sf), today=AS_OF, level=LEVEL)


@register("alert_check", sql.query(ALL_CTES, ALL_ALERTS, ["peak"]))
def _(spark, sf):
    return alerts_of(spark, sf)


@register("alert_check_other_day", sql.query(ALL_CTES, ALL_ALERTS.split("UNION ALL")[0]))
def _(spark, sf):
    """On any day but today the forecast says nothing."""
    later = AS_OF + timedelta(days=1)
    return al.check(seasons_of(spark, sf), AS_OF, forecast_of(spark, sf), today=later, level=LEVEL)


SITES = "places AS (SELECT DISTINCT city FROM seasons UNION SELECT DISTINCT city FROM event_hours)"


@register(
    "site_status",
    sql.query(
        [*ALL_CTES, sql.TYPICAL, ACTIVE, SITES],
        f"""SELECT p.city, CASE
              WHEN EXISTS (SELECT 1 FROM active a WHERE a.city = p.city)
                OR EXISTS (SELECT 1 FROM found f WHERE f.city = p.city) THEN 'red'
              WHEN EXISTS (SELECT 1 FROM coming c WHERE c.city = p.city) THEN 'yellow'
              ELSE 'green' END AS status
            FROM places p""",
    ),
)
def _(spark, sf):
    from workload.fixtures import event_hours

    seasons = seasons_of(spark, sf)
    places = seasons.select("city").union(event_hours(spark, sf).select("city")).distinct()
    return al.site_status(alerts_of(spark, sf), al.in_typical_season(seasons, ACTIVE_ON), places)


@register(
    "active_species",
    sql.query(
        [*ALL_CTES, sql.TYPICAL, ACTIVE],
        """SELECT city, pollen_type FROM active UNION SELECT city, pollen_type FROM coming
           UNION SELECT city, pollen_type FROM found""",
    ),
)
def _(spark, sf):
    return al.active_species(alerts_of(spark, sf), al.in_typical_season(seasons_of(spark, sf), ACTIVE_ON))


NEXT = f"CASE WHEN {_doy('start_doy', 2000)} > DATE '{AS_OF}' THEN {_doy('start_doy', 2000)} ELSE {_doy('start_doy', 2001)} END"


@register(
    "next_season",
    sql.query(
        [*SEASONS, sql.TYPICAL],
        f"""SELECT city, pollen_type, {NEXT} AS start FROM typical
            QUALIFY row_number() OVER (PARTITION BY city ORDER BY {NEXT}, pollen_type) = 1""",
    ),
)
def _(spark, sf):
    return al.next_season(seasons_of(spark, sf), AS_OF)


AHEAD = "CASE WHEN start_doy > 200 THEN start_doy ELSE start_doy + 365 END"


@register(
    "next_season_doy",
    sql.query(
        [*SEASONS, sql.TYPICAL],
        f"""SELECT city, pollen_type, CASE WHEN {AHEAD} % 365 = 0 THEN 365 ELSE {AHEAD} % 365 END AS start_doy
            FROM typical QUALIFY row_number() OVER (PARTITION BY city ORDER BY {AHEAD}, pollen_type) = 1""",
        ["start_doy"],
    ),
)
def _(spark, sf):
    return al.next_season_doy(seasons_of(spark, sf), date(2001, 7, 19))


KEY = "ch || '|' || city || '|' || pollen_type || '|coming|' || year(start)"
CHANNELS = "(SELECT unnest(['desktop', 'push']) AS ch)"


@register(
    "unsent_alerts",
    sql.query(
        [*SEASONS, COMING, _coming("earlier", EARLIER)],
        f"""SELECT city, pollen_type, start, ch AS channel, {KEY} AS alert_key FROM coming, {CHANNELS}
            WHERE {KEY} NOT IN (SELECT {KEY} FROM earlier, (SELECT 'push' AS ch))""",
    ),
)
def _(spark, sf):
    seasons = seasons_of(spark, sf)
    now = al.with_keys(al.coming_alerts(seasons, AS_OF), ["desktop", "push"])
    sent = al.with_keys(al.coming_alerts(seasons, EARLIER), ["push"])
    return al.unsent(now, sent).select("city", "pollen_type", "start", "channel", "alert_key")


@register(
    "forecast_alert_keys",
    sql.query(
        FORECAST_CTES,
        """SELECT city, pollen_type, 'push|' || city || '|' || pollen_type || '|forecast|'
             || strftime(from_time, '%Y-%m-%d') AS alert_key FROM found""",
    ),
)
def _(spark, sf):
    found = al.forecast_alerts(forecast_of(spark, sf), level=LEVEL)
    return al.with_keys(found, ["push"]).select("city", "pollen_type", F.col("alert_key"))
