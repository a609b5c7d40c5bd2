"""Staging, marts, local time, missing values."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from stationlake.functions.calendar import local_time
from stationlake.plans import marts
from stationlake.plans.refresh import read_mart, refresh
from stationlake.session import work_path
from stationlake.sources import tables as tb
from workload import sql
from workload.fixtures import obs_daily, raw_air, raw_weather, stored, table
from workload.registry import register

VARIABLES = ["alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen"]


def hourly_mart(spark, sf):
    return marts.hourly(
        marts.stage_air_quality(raw_air(spark, sf)), marts.stage_weather(raw_weather(spark, sf))
    )


def daily_mart(spark, sf):
    return marts.daily(hourly_mart(spark, sf), min_hours=4)


@register("stage_air_quality", sql.query([sql.SITE_LINES, sql.RAW_AIR, sql.STG_AIR], "SELECT * FROM stg_air"))
def _(spark, sf):
    return marts.stage_air_quality(raw_air(spark, sf))


@register(
    "stage_weather",
    sql.query([sql.SITE_LINES, sql.RAW_WEATHER, sql.STG_WEATHER], "SELECT * FROM stg_weather"),
)
def _(spark, sf):
    return marts.stage_weather(raw_weather(spark, sf))


@register("hourly_left_join", sql.query(sql.MART_CHAIN[:-1], "SELECT * FROM hourly"))
def _(spark, sf):
    return hourly_mart(spark, sf)


@register(
    "daily_rollup",
    sql.query(sql.MART_CHAIN, "SELECT * FROM daily", sql.DAILY_MEASURES, longs=["n_hours"]),
)
def _(spark, sf):
    return daily_mart(spark, sf)


@register(
    "weekly_iso_rollup",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily(), sql.weekly()],
        "SELECT * FROM weekly",
        [
            *[f"{s}_pollen_{a}" for s in sql.SPECIES for a in ("avg", "max")],
            "pm2_5_avg", "ozone_avg", "temperature_avg_c", "precipitation_mm", "wind_speed_avg_kmh",
        ],
        longs=["n_days"],
    ),
)
def _(spark, sf):
    return marts.weekly(obs_daily(spark, sf))


@register(
    "complete_days",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT city, time::DATE AS date_local, sum(n) AS readings, count(*) AS n_hours
           FROM event_hours GROUP BY ALL HAVING count(*) >= 23""",
        longs=["readings", "n_hours"],
    ),
)
def _(spark, sf):
    from workload.fixtures import event_hours

    hours = event_hours(spark, sf)
    return (
        hours.groupBy("city", F.to_date("time").alias("date_local"))
        .agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("n_hours"))
        .filter(F.col("n_hours") >= 23)
    )


@register(
    "local_time",
    """SELECT event_id, timezone('Europe/Stockholm', ts AT TIME ZONE 'UTC') AS time_local,
         timezone('Europe/Stockholm', ts AT TIME ZONE 'UTC')::DATE AS date_local,
         hour(timezone('Europe/Stockholm', ts AT TIME ZONE 'UTC'))::INTEGER AS hour_local
       FROM events""",
)
def _(spark, sf):
    local = local_time("ts")
    return table(spark, sf, "events").select(
        "event_id",
        local.alias("time_local"),
        F.to_date(local).alias("date_local"),
        F.hour(local).alias("hour_local"),
    )


SEASON_FLOATS = ["peak_pollen", "year_total"]


@register(
    "seasons_5_95",
    sql.query([sql.SITE_LINES, sql.obs_daily(), sql.seasons()], "SELECT * FROM seasons", SEASON_FLOATS),
)
def _(spark, sf):
    return marts.seasons(obs_daily(spark, sf))


@register(
    "seasons_3_97",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily("n_name"), sql.seasons(lo=0.03, hi=0.97)],
        "SELECT * FROM seasons",
        SEASON_FLOATS,
    ),
)
def _(spark, sf):
    return marts.seasons(obs_daily(spark, sf, "n_name"), lo=0.03, hi=0.97)


@register(
    "seasons_of_daily_mart",
    sql.query([*sql.MART_CHAIN, sql.seasons("daily")], "SELECT * FROM seasons", SEASON_FLOATS),
)
def _(spark, sf):
    return marts.seasons(daily_mart(spark, sf))


def _missing(raw: str, source: str, variables: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{source}' AS source, city, year(time) AS year, '{v}' AS variable,
              count(*) AS n_rows, count(*) - count({v}) AS n_missing,
              round(100.0::DOUBLE * (count(*) - count({v})) / count(*), 1) AS pct_missing
            FROM {raw} GROUP BY ALL"""
        for v in variables
    )


AIR = [*VARIABLES, "pm2_5", "pm10", "ozone", "nitrogen_dioxide"]
WEATHER = ["temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_direction_10m"]
MISSING = f"{_missing('raw_air', 'air_quality', AIR)} UNION ALL {_missing('raw_weather', 'weather', WEATHER)}"


@register(
    "missing_values",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR, sql.RAW_WEATHER],
        MISSING,
        ["pct_missing"],
        ["year"],
        ["n_rows", "n_missing"],
    ),
)
def missing(spark, sf):
    return marts.missing_values(
        {"air_quality": raw_air(spark, sf), "weather": raw_weather(spark, sf)}
    )


@register(
    "daily_local_from_raw",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR],
        f"""SELECT city, timezone('Europe/Stockholm', time AT TIME ZONE 'UTC')::DATE AS day,
              {", ".join(f"avg({v}) AS {v}" for v in VARIABLES)}
            FROM raw_air GROUP BY ALL""",
        VARIABLES,
    ),
)
def daily_raw(spark, sf):
    return marts.daily_means(raw_air(spark, sf), VARIABLES)


@register(
    "monthly_means",
    sql.query(
        [
            sql.SITE_LINES,
            sql.RAW_AIR,
            f"""day_means AS (
              SELECT city, timezone('Europe/Stockholm', time AT TIME ZONE 'UTC')::DATE AS day,
                {", ".join(f"avg({v}) AS {v}" for v in VARIABLES)}
              FROM raw_air GROUP BY ALL)""",
        ],
        f"""SELECT month(day) AS month, {", ".join(f"round(avg({v}), 1) AS {v}" for v in VARIABLES)}
            FROM day_means WHERE year(day) IN (1998, 1999) GROUP BY ALL""",
        VARIABLES,
        ["month"],
    ),
)
def _(spark, sf):
    return marts.monthly_means(daily_raw(spark, sf), VARIABLES, [1998, 1999])


def _until(df, day):
    return df.filter(F.col("time") < F.lit(day).cast("timestamp_ntz"))


def _from(df, day):
    return df.filter(F.col("time") >= F.lit(day).cast("timestamp_ntz"))


SNAPSHOTS: dict[tuple[str, str], str] = {}


def snapshot_of_loads(spark, sf, name):
    """One mart of the snapshot of all five; a session loads and exports each set of tables once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in SNAPSHOTS or not tb.table_exists(spark, SNAPSHOTS[key]):
        SNAPSHOTS[key] = loaded_twice(spark, sf)
    return tb.read_snapshot(spark, SNAPSHOTS[key])[name]


def loaded_twice(spark, sf):
    """Snapshot after two loads: the second corrects the end of the first, brings the later rows and late weather."""
    folder, exported = work_path(spark, "marts"), work_path(spark, "snapshot")
    air, weather = stored(raw_air(spark, sf), "air"), stored(raw_weather(spark, sf), "weather")
    wrong = F.when(F.col("time") >= F.lit("1997-11-05").cast("timestamp_ntz"), F.col("birch_pollen") * 3 + 1)
    early = _until(air, "1998-01-01").withColumn("birch_pollen", F.coalesce(wrong, F.col("birch_pollen")))
    refresh(spark, folder, early, _until(weather, "1997-10-20"), min_hours=4)
    refresh(spark, folder, _from(air, "1997-11-05"), _from(weather, "1997-10-20"), min_hours=4)
    tb.export_snapshot({m: read_mart(spark, folder, m) for m in tb.MARTS}, exported)
    return exported


WEEKLY_MEASURES = [
    *[f"{s}_pollen_{a}" for s in sql.SPECIES for a in ("avg", "max")],
    "pm2_5_avg", "ozone_avg", "temperature_avg_c", "precipitation_mm", "wind_speed_avg_kmh",
]

# The marts built anew from all rows.
REBUILT = {
    "hourly": sql.query(sql.MART_CHAIN[:-1], "SELECT * FROM hourly"),
    "daily": sql.query(sql.MART_CHAIN, "SELECT * FROM daily", sql.DAILY_MEASURES, longs=["n_hours"]),
    "weekly": sql.query([*sql.MART_CHAIN, sql.weekly("daily")], "SELECT * FROM weekly", WEEKLY_MEASURES, longs=["n_days"]),
    "seasons": sql.query([*sql.MART_CHAIN, sql.seasons("daily")], "SELECT * FROM seasons", SEASON_FLOATS),
    "missing_values": sql.query(
        [sql.SITE_LINES, sql.RAW_AIR, sql.RAW_WEATHER], MISSING, ["pct_missing"], ["year"], ["n_rows", "n_missing"]
    ),
}

for mart, rebuilt in REBUILT.items():
    register(f"loaded_{mart}", rebuilt)(partial(snapshot_of_loads, name=mart))
