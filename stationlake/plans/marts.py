"""Raw -> staging -> hourly, daily, weekly, seasons and missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.calendar import iso_week, iso_year, local_time, season_length
from stationlake.model import SPECIES, ZONE, daily_columns
from stationlake.operators.reshape import all_except


def stage_air_quality(
    raw: DataFrame, zone: str = ZONE, species: Sequence[str] = SPECIES
) -> DataFrame:
    """Adds local time; an unknown species count becomes 0, pollution stays unknown."""
    return raw.select(
        "city",
        F.col("time").alias("time_utc"),
        local_time("time", zone).alias("time_local"),
        *[F.coalesce(f"{s}_pollen", F.lit(0.0)).alias(f"{s}_pollen") for s in species],
        "pm2_5",
        "pm10",
        "ozone",
        F.col("nitrogen_dioxide").alias("no2"),
    )


def stage_weather(raw: DataFrame, zone: str = ZONE) -> DataFrame:
    """Adds local time and puts the unit into the column names."""
    return raw.select(
        "city",
        F.col("time").alias("time_utc"),
        local_time("time", zone).alias("time_local"),
        F.col("temperature_2m").alias("temperature_c"),
        F.col("relative_humidity_2m").alias("humidity_pct"),
        F.col("precipitation").alias("precipitation_mm"),
        F.col("wind_speed_10m").alias("wind_speed_kmh"),
        F.col("wind_direction_10m").alias("wind_direction_deg"),
    )


def hourly(air: DataFrame, weather: DataFrame) -> DataFrame:
    """One row per site and hour of the air table, weather attached where there is any."""
    keys = ["city", "time_utc", "time_local"]
    measures = all_except(air, *keys)
    return air.join(weather.drop("time_local"), ["city", "time_utc"], "left").select(
        *keys,
        F.to_date("time_local").alias("date_local"),
        F.hour("time_local").alias("hour_local"),
        *measures,
        *all_except(weather, *keys),
    )


def daily(
    hours: DataFrame, min_hours: int = 23, species: Sequence[str] = SPECIES
) -> DataFrame:
    """One row per site and local day; days with fewer than ``min_hours`` hours are dropped."""
    aggs: list[Column] = []
    for s in species:
        aggs += [
            F.avg(f"{s}_pollen").alias(f"{s}_pollen_avg"),
            F.max(f"{s}_pollen").alias(f"{s}_pollen_max"),
        ]
    aggs += [
        F.avg("pm2_5").alias("pm2_5_avg"),
        F.max("pm2_5").alias("pm2_5_max"),
        F.avg("pm10").alias("pm10_avg"),
        F.avg("ozone").alias("ozone_avg"),
        F.max("ozone").alias("ozone_max"),
        F.avg("no2").alias("no2_avg"),
        F.avg("temperature_c").alias("temperature_avg_c"),
        F.min("temperature_c").alias("temperature_min_c"),
        F.max("temperature_c").alias("temperature_max_c"),
        F.avg("humidity_pct").alias("humidity_avg_pct"),
        F.sum("precipitation_mm").alias("precipitation_mm"),
        F.avg("wind_speed_kmh").alias("wind_speed_avg_kmh"),
        F.count(F.lit(1)).alias("n_hours"),
    ]
    return hours.groupBy("city", "date_local").agg(*aggs).filter(F.col("n_hours") >= min_hours)


def weekly(days: DataFrame, species: Sequence[str] = SPECIES) -> DataFrame:
    """One row per site and ISO week: mean of daily means, highest daily maximum, sum of rain."""
    aggs: list[Column] = [F.min("date_local").alias("week_start")]
    for s in species:
        aggs += [
            F.avg(f"{s}_pollen_avg").alias(f"{s}_pollen_avg"),
            F.max(f"{s}_pollen_max").alias(f"{s}_pollen_max"),
        ]
    aggs += [
        F.avg("pm2_5_avg").alias("pm2_5_avg"),
        F.avg("ozone_avg").alias("ozone_avg"),
        F.avg("temperature_avg_c").alias("temperature_avg_c"),
        F.sum("precipitation_mm").alias("precipitation_mm"),
        F.avg("wind_speed_avg_kmh").alias("wind_speed_avg_kmh"),
        F.count(F.lit(1)).alias("n_days"),
    ]
    return days.groupBy(
        "city",
        iso_year("date_local").alias("iso_year"),
        iso_week("date_local").alias("iso_week"),
    ).agg(*aggs)


def cumulative_seasons(
    days: DataFrame,
    columns: Mapping[str, str] | None = None,
    lo: float = 0.05,
    hi: float = 0.95,
) -> DataFrame:
    """Start, peak and end per site, species and calendar year from the running yearly sum.

    Start and end are the first days on which the running sum reaches the
    shares ``lo`` and ``hi`` of the yearly sum; the peak is the earliest day
    with the highest value. Years without any count are dropped.

    All species share one shuffle and one sort by (site, year): a window there
    holds at most 366 rows because the daily table has one row per site and
    day. Only the result is turned from columns to rows.
    """
    columns = dict(columns or daily_columns())
    of_year = Window.partitionBy("city", "year")
    to_date = of_year.orderBy("date_local").rowsBetween(Window.unboundedPreceding, 0)
    base = days.select(
        "city",
        "date_local",
        F.year("date_local").alias("year"),
        *[F.col(c).alias(f"v_{s}") for s, c in columns.items()],
    )
    running = base.select(
        "*",
        *[F.sum(f"v_{s}").over(to_date).alias(f"run_{s}") for s in columns],
        *[F.sum(f"v_{s}").over(of_year).alias(f"sum_{s}") for s in columns],
        *[F.max(f"v_{s}").over(of_year).alias(f"max_{s}") for s in columns],
    )

    def first_day(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("date_local")))

    aggs = []
    for s in columns:
        run, total, top = F.col(f"run_{s}"), F.col(f"sum_{s}"), F.col(f"max_{s}")
        aggs += [
            first_day(run >= F.lit(lo) * total).alias(f"start_{s}"),
            first_day(F.col(f"v_{s}") == top).alias(f"peak_{s}"),
            first_day(run >= F.lit(hi) * total).alias(f"end_{s}"),
            F.max(top).alias(f"top_{s}"),
            F.max(total).alias(f"total_{s}"),
        ]
    per_year = running.groupBy("city", "year").agg(*aggs)
    as_rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("pollen_type"),
                    F.col(f"start_{s}").alias("season_start"),
                    F.col(f"peak_{s}").alias("peak_date"),
                    F.col(f"end_{s}").alias("season_end"),
                    F.col(f"top_{s}").alias("peak_pollen"),
                    F.col(f"total_{s}").alias("year_total"),
                )
                for s in columns
            ]
        )
    )
    return per_year.select("city", "year", as_rows).filter(F.col("year_total") > 0)


def seasons(
    days: DataFrame,
    columns: Mapping[str, str] | None = None,
    lo: float = 0.05,
    hi: float = 0.95,
) -> DataFrame:
    """The seasons table: dates, their ISO weeks, length, peak and yearly sum."""
    return cumulative_seasons(days, columns, lo, hi).select(
        "city",
        "pollen_type",
        "year",
        "season_start",
        "peak_date",
        "season_end",
        iso_week("season_start").alias("start_week"),
        iso_week("peak_date").alias("peak_week"),
        iso_week("season_end").alias("end_week"),
        season_length("season_start", "season_end").alias("season_days"),
        "peak_pollen",
        "year_total",
    )


def missing_values(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("city", "time")) -> DataFrame:
    """Rows and missing values per source, site, year and variable, for every other column.

    Each source is read once: the counts of all its variables come from one aggregation.
    """

    def of_source(name: str, raw: DataFrame) -> DataFrame:
        variables = all_except(raw, *keys, "loaded_at")
        counts = raw.groupBy("city", F.year("time").alias("year")).agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[F.count(v).alias(v) for v in variables],
        )
        long = counts.unpivot(["city", "year", "n_rows"], variables, "variable", "__n_values")
        return long.withColumn("source", F.lit(name))

    everything = reduce(DataFrame.unionByName, [of_source(n, df) for n, df in sources.items()])
    missing = F.col("n_rows") - F.col("__n_values")
    return everything.select(
        "source",
        "city",
        "year",
        "variable",
        "n_rows",
        missing.alias("n_missing"),
        F.round(F.lit(100.0) * missing / F.col("n_rows"), 1).alias("pct_missing"),
    )


def daily_means(raw: DataFrame, variables: Sequence[str], zone: str = ZONE) -> DataFrame:
    """Daily means in local time straight from a raw table."""
    day = F.to_date(local_time("time", zone))
    return raw.groupBy("city", day.alias("day")).agg(*[F.avg(v).alias(v) for v in variables])


def monthly_means(days: DataFrame, variables: Sequence[str], years: Sequence[int]) -> DataFrame:
    """Mean per calendar month over the given complete years, one decimal."""
    return (
        days.filter(F.year("day").isin(list(years)))
        .groupBy(F.month("day").alias("month"))
        .agg(*[F.round(F.avg(v), 1).alias(v) for v in variables])
    )
