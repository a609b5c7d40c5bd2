"""SQL counterparts of the stand-in tables, and helpers to put a check query together."""

from __future__ import annotations

from collections.abc import Sequence

SPECIES = ["alder", "birch", "grass", "mugwort"]
CONDITIONS = {
    "alder": "l_returnflag = 'A'",
    "birch": "l_returnflag = 'N'",
    "grass": "l_returnflag = 'R'",
    "mugwort": "l_linestatus = 'F'",
}

SITE_LINES = """
site_lines AS (
  SELECT l.*, o_orderdate, n_name, r_name
  FROM lineitem l
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""


def obs_daily(site: str = "r_name") -> str:
    avg = ", ".join(
        f"coalesce(sum(l_quantity) FILTER (WHERE {c}), 0.0)::DOUBLE AS {s}_pollen_avg"
        for s, c in CONDITIONS.items()
    )
    top = ", ".join(
        f"coalesce(max(l_quantity) FILTER (WHERE {c}), 0.0)::DOUBLE AS {s}_pollen_max"
        for s, c in CONDITIONS.items()
    )
    return f"""
obs_daily AS (
  SELECT {site} AS city, l_shipdate::DATE AS date_local, {avg}, {top},
    count(*)::DOUBLE AS pm2_5_avg,
    sum(l_linenumber)::DOUBLE AS ozone_avg,
    (count(*) FILTER (WHERE l_linestatus = 'O'))::DOUBLE AS no2_avg,
    min(l_quantity) AS temperature_avg_c,
    max(l_quantity) AS temperature_max_c,
    min(l_linenumber)::DOUBLE AS humidity_avg_pct,
    (count(*) FILTER (WHERE l_linestatus = 'F'))::DOUBLE AS precipitation_mm,
    max(l_linenumber)::DOUBLE AS wind_speed_avg_kmh,
    count(*) AS n_hours
  FROM site_lines GROUP BY ALL
)"""


RAW_AIR = f"""
raw_air AS (
  SELECT r_name AS city, l_shipdate + to_hours(l_linenumber * 3) AS time,
    {", ".join(f"sum(l_quantity) FILTER (WHERE {c}) AS {s}_pollen" for s, c in CONDITIONS.items())},
    count(*)::DOUBLE AS pm2_5, max(l_quantity) AS pm10, sum(l_quantity) AS ozone,
    min(l_quantity) AS nitrogen_dioxide, TIMESTAMP '2002-01-01' AS loaded_at
  FROM site_lines GROUP BY ALL
)"""

RAW_WEATHER = """
raw_weather AS (
  SELECT r_name AS city, o_orderdate + to_hours(l_linenumber * 3) AS time,
    max(l_quantity) AS temperature_2m, min(l_quantity) AS relative_humidity_2m,
    (count(*) FILTER (WHERE l_linestatus = 'F'))::DOUBLE AS precipitation,
    max(l_linenumber)::DOUBLE AS wind_speed_10m, sum(l_quantity) AS wind_direction_10m,
    TIMESTAMP '2002-01-01' AS loaded_at
  FROM site_lines GROUP BY ALL
)"""

STG_AIR = f"""
stg_air AS (
  SELECT city, time AS time_utc,
    timezone('Europe/Stockholm', time AT TIME ZONE 'UTC') AS time_local,
    {", ".join(f"coalesce({s}_pollen, 0.0)::DOUBLE AS {s}_pollen" for s in SPECIES)},
    pm2_5, pm10, ozone, nitrogen_dioxide AS no2
  FROM raw_air
)"""

STG_WEATHER = """
stg_weather AS (
  SELECT city, time AS time_utc,
    timezone('Europe/Stockholm', time AT TIME ZONE 'UTC') AS time_local,
    temperature_2m AS temperature_c, relative_humidity_2m AS humidity_pct,
    precipitation AS precipitation_mm, wind_speed_10m AS wind_speed_kmh,
    wind_direction_10m AS wind_direction_deg
  FROM raw_weather
)"""

HOURLY = f"""
hourly AS (
  SELECT a.city, a.time_utc, a.time_local, a.time_local::DATE AS date_local,
    hour(a.time_local)::INTEGER AS hour_local,
    {", ".join(f"a.{s}_pollen" for s in SPECIES)}, a.pm2_5, a.pm10, a.ozone, a.no2,
    w.temperature_c, w.humidity_pct, w.precipitation_mm, w.wind_speed_kmh, w.wind_direction_deg
  FROM stg_air a LEFT JOIN stg_weather w ON a.city = w.city AND a.time_utc = w.time_utc
)"""

DAILY = f"""
daily AS (
  SELECT city, date_local,
    {", ".join(f"avg({s}_pollen) AS {s}_pollen_avg, max({s}_pollen) AS {s}_pollen_max" for s in SPECIES)},
    avg(pm2_5) AS pm2_5_avg, max(pm2_5) AS pm2_5_max, avg(pm10) AS pm10_avg,
    avg(ozone) AS ozone_avg, max(ozone) AS ozone_max, avg(no2) AS no2_avg,
    avg(temperature_c) AS temperature_avg_c, min(temperature_c) AS temperature_min_c,
    max(temperature_c) AS temperature_max_c, avg(humidity_pct) AS humidity_avg_pct,
    sum(precipitation_mm) AS precipitation_mm, avg(wind_speed_kmh) AS wind_speed_avg_kmh,
    count(*) AS n_hours
  FROM hourly GROUP BY city, date_local HAVING count(*) >= 4
)"""

MART_CHAIN = [SITE_LINES, RAW_AIR, RAW_WEATHER, STG_AIR, STG_WEATHER, HOURLY, DAILY]

DAILY_MEASURES = [
    *[f"{s}_pollen_{a}" for s in SPECIES for a in ("avg", "max")],
    "pm2_5_avg", "pm2_5_max", "pm10_avg", "ozone_avg", "ozone_max", "no2_avg",
    "temperature_avg_c", "temperature_min_c", "temperature_max_c", "humidity_avg_pct",
    "precipitation_mm", "wind_speed_avg_kmh",
]


def weekly(daily: str = "obs_daily") -> str:
    species = ", ".join(
        f"avg({s}_pollen_avg) AS {s}_pollen_avg, max({s}_pollen_max) AS {s}_pollen_max" for s in SPECIES
    )
    return f"""
weekly AS (
  SELECT city, isoyear(date_local)::INTEGER AS iso_year, week(date_local)::INTEGER AS iso_week,
    min(date_local) AS week_start, {species},
    avg(pm2_5_avg) AS pm2_5_avg, avg(ozone_avg) AS ozone_avg,
    avg(temperature_avg_c) AS temperature_avg_c, sum(precipitation_mm) AS precipitation_mm,
    avg(wind_speed_avg_kmh) AS wind_speed_avg_kmh, count(*) AS n_days
  FROM {daily} GROUP BY ALL
)"""


def long_daily(daily: str = "obs_daily", species: Sequence[str] = SPECIES) -> str:
    return " UNION ALL ".join(
        f"SELECT city, date_local, '{s}' AS pollen_type, {s}_pollen_avg AS pollen FROM {daily}"
        for s in species
    )


def seasons(daily: str = "obs_daily", lo: float = 0.05, hi: float = 0.95, name: str = "seasons") -> str:
    return f"""
{name}_long AS ({long_daily(daily)}),
{name}_run AS (
  SELECT *, year(date_local)::INTEGER AS year,
    sum(pollen) OVER (PARTITION BY city, pollen_type, year(date_local) ORDER BY date_local) AS run,
    sum(pollen) OVER (PARTITION BY city, pollen_type, year(date_local)) AS total,
    max(pollen) OVER (PARTITION BY city, pollen_type, year(date_local)) AS top
  FROM {name}_long WHERE pollen IS NOT NULL
),
{name} AS (
  SELECT *, week(season_start)::INTEGER AS start_week, week(peak_date)::INTEGER AS peak_week,
    week(season_end)::INTEGER AS end_week,
    (date_diff('day', season_start, season_end) + 1)::INTEGER AS season_days
  FROM (
    SELECT city, pollen_type, year,
      min(date_local) FILTER (WHERE run >= {lo}::DOUBLE * total) AS season_start,
      min(date_local) FILTER (WHERE pollen = top) AS peak_date,
      min(date_local) FILTER (WHERE run >= {hi}::DOUBLE * total) AS season_end,
      max(pollen) AS peak_pollen, any_value(total) AS year_total
    FROM {name}_run WHERE total > 0 GROUP BY ALL
  )
)"""


def capital(column: str = "pollen_type") -> str:
    return f"upper({column}[1]) || {column}[2:]"


TYPICAL = f"""
typical AS (
  SELECT {capital()} AS pollen_type, city,
    median(dayofyear(season_start))::DOUBLE AS start_doy,
    median(dayofyear(peak_date))::DOUBLE AS peak_doy,
    median(dayofyear(season_end))::DOUBLE AS end_doy
  FROM seasons GROUP BY ALL
)"""


def any_above(levels: dict[str, float] | float, prefix: str = "") -> str:
    level = levels if isinstance(levels, dict) else {s: levels for s in SPECIES}
    return "(" + " OR ".join(f"{prefix}{s}_pollen_avg > {level[s]}" for s in SPECIES) + ")"


EVENT_HOURS = """
event_hours AS (
  SELECT event_type AS city, date_trunc('hour', ts) AS time,
    sum(cents) FILTER (WHERE k BETWEEN 0 AND 24)::DOUBLE AS alder_pollen,
    sum(cents) FILTER (WHERE k BETWEEN 25 AND 49)::DOUBLE AS birch_pollen,
    sum(cents) FILTER (WHERE k BETWEEN 50 AND 74)::DOUBLE AS grass_pollen,
    sum(cents) FILTER (WHERE k BETWEEN 75 AND 99)::DOUBLE AS mugwort_pollen,
    count(*) AS n
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k, round(value * 100)::BIGINT AS cents FROM events)
  GROUP BY ALL
)"""

SNAPSHOTS = """
snapshots AS (
  SELECT city, date_trunc('day', time) + to_hours(24 * s + 12) AS fetched_at, time,
    alder_pollen, birch_pollen, grass_pollen, mugwort_pollen
  FROM event_hours, (SELECT unnest(range(-3, 3)) AS s)
)"""


def query(
    ctes: Sequence[str],
    body: str,
    floats: Sequence[str] = (),
    ints: Sequence[str] = (),
    longs: Sequence[str] = (),
) -> str:
    """A check query: common tables, body, and the result's types.

    Floats are rounded to six decimals like the Spark side; the added zero
    turns a negative zero into zero.
    """
    replaced = [
        *[f"round({c}, 6)::DOUBLE + 0.0 AS {c}" for c in (f'"{f}"' for f in floats)],
        *[f'"{c}"::INTEGER AS "{c}"' for c in ints],
        *[f'"{c}"::BIGINT AS "{c}"' for c in longs],
    ]
    star = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
    with_ = f"WITH {', '.join(c.strip() for c in ctes)} " if ctes else ""
    return f"{with_}SELECT {star} FROM ({body})"
