"""Typical seasons, weekly calendars, profiles of the day, monthly context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.calendar import iso_week, on_leap_year
from stationlake.functions.conditions import above, any_above, pick
from stationlake.model import HIGH, daily_columns, hourly_columns
from stationlake.operators.order_stats import quantiles
from stationlake.operators.reshape import unpivot
from stationlake.operators.runs import ratio_to_mean


def _suffixed(columns: Mapping[str, str]) -> dict[str, str]:
    """Capitalised species -> column."""
    return {s.capitalize(): c for s, c in columns.items()}


def seasons_with_doy(seasons: DataFrame) -> DataFrame:
    """Seasons with capitalised species and the day of year of start, peak and end."""
    return seasons.withColumns(
        {
            "pollen_type": F.initcap("pollen_type"),
            "start_doy": F.dayofyear("season_start"),
            "peak_doy": F.dayofyear("peak_date"),
            "end_doy": F.dayofyear("season_end"),
        }
    )


def typical_seasons(seasons: DataFrame) -> DataFrame:
    """Median day of year of start, peak and end per species and site, over the years."""
    return (
        seasons_with_doy(seasons)
        .groupBy("pollen_type", "city")
        .agg(*[F.median(c).alias(c) for c in ("start_doy", "peak_doy", "end_doy")])
    )


def typical_calendar(seasons: DataFrame) -> DataFrame:
    """Median dates on the calendar of a leap year, and median weeks.

    A median between two days keeps its half day as a timestamp.
    """
    def middle(day: str):
        days = F.median(F.unix_date(on_leap_year(day)).cast("double"))
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_add("HOUR", (days * 24).cast("int"), start)

    return (
        seasons.withColumn("pollen_type", F.initcap("pollen_type"))
        .groupBy("pollen_type", "city")
        .agg(
            middle("season_start").alias("start"),
            middle("peak_date").alias("peak"),
            middle("season_end").alias("end"),
            F.median("start_week").alias("start_week"),
            F.median("peak_week").alias("peak_week"),
            F.median("end_week").alias("end_week"),
        )
    )


def weekly_by_year(weeks: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Weekly means in long form; week 53 is left out."""
    return unpivot(
        weeks.filter(F.col("iso_week") <= 52),
        ["city", "iso_year", "iso_week"],
        _suffixed(columns or daily_columns()),
        "pollen_type",
        "grains",
        keep_null=True,
    )


def weekly_climatology(weeks: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Weekly means averaged over all years.

    The years are averaged before the columns become rows, so the shuffle
    carries one row per site and week instead of one per species.
    """
    columns = _suffixed(columns or daily_columns())
    means = (
        weeks.filter(F.col("iso_week") <= 52)
        .groupBy("city", "iso_week")
        .agg(*[F.avg(c).alias(s) for s, c in columns.items()])
    )
    return unpivot(
        means, ["city", "iso_week"], {s: s for s in columns}, "pollen_type", "grains", True
    )


def daily_flags(
    days: DataFrame, columns: Mapping[str, str] | None = None, levels: Mapping[str, float] = HIGH
) -> DataFrame:
    """Daily rows with year, month, ISO week and the flags ``high_<Species>`` and ``high_any``."""
    columns = columns or daily_columns()
    flags = {f"high_{s.capitalize()}": f for s, f in above(columns, levels).items()}
    return days.withColumns(
        {
            "year": F.year("date_local"),
            "month": F.month("date_local"),
            "week": iso_week("date_local"),
            **flags,
            "high_any": any_above(columns, levels),
        }
    )


def in_season(rows: DataFrame, seasons: DataFrame, kind: str = "pollen_type") -> DataFrame:
    """Rows of an hourly or daily table inside each season of their site.

    A season lies within its calendar year, so (site, year) is an equality key
    and the dates stay a residual filter: no pair outside a site's year is
    formed. A row can match several species.
    """
    dated = rows.withColumn("__year", F.year("date_local"))
    spans = seasons.select(
        F.col("city").alias("__city"),
        F.col("pollen_type").alias(kind),
        "year",
        "season_start",
        "season_end",
    )
    on = (
        (F.col("city") == F.col("__city"))
        & (F.col("__year") == F.col("year"))
        & F.col("date_local").between(F.col("season_start"), F.col("season_end"))
    )
    clash = [c for c in ("year", "season_start", "season_end", kind) if c in dated.columns]
    return dated.drop(*clash).join(spans, on).drop("__city", "__year")


def hour_profile(
    hours: DataFrame,
    seasons: DataFrame,
    columns: Mapping[str, str] | None = None,
    pooled: bool = False,
) -> DataFrame:
    """Mean per hour of the day on season days; index 100 = plain mean of the hourly means.

    ``pooled`` puts all sites together instead of one profile per site.
    """
    columns = columns or hourly_columns()
    groups = ["pollen_type"] if pooled else ["city", "pollen_type"]
    inside = in_season(
        hours.select("city", "date_local", "hour_local", *columns.values()), seasons
    )
    means = (
        inside.groupBy(*groups, "hour_local")
        .agg(F.avg(pick("pollen_type", columns)).alias("grains"))
        .withColumn("pollen_type", F.initcap("pollen_type"))
    )
    return ratio_to_mean(means, groups, "grains", "index", scale=100.0)


def mean_profile(profile: DataFrame) -> DataFrame:
    """Profile averaged over sites, per species and hour."""
    return profile.groupBy("pollen_type", "hour_local").agg(F.avg("index").alias("index"))


def lowest_hour(profile: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The hour with the lowest index per group; the earlier hour wins a tie."""
    low = F.min(F.struct("index", "hour_local"))
    return (
        profile.filter(F.col("index").isNotNull())
        .groupBy(*groups)
        .agg(low.alias("__low"))
        .select(
            *groups,
            F.col("__low.hour_local").alias("hour_local"),
            F.col("__low.index").alias("index"),
        )
    )


def lowest_highest_hour(profile: DataFrame) -> DataFrame:
    """Hours with the lowest and the highest index per species and site; ties: earlier hour."""
    low = F.min(F.struct(F.col("index"), F.col("hour_local")))
    high = F.min(F.struct((-F.col("index")).alias("neg"), F.col("hour_local")))
    return (
        profile.filter(F.col("index").isNotNull())
        .groupBy("pollen_type", "city")
        .agg(low.alias("__low"), high.alias("__high"))
        .select(
            "pollen_type",
            "city",
            F.col("__low.hour_local").alias("hour_local_low"),
            F.col("__low.index").alias("index_low"),
            F.col("__high.hour_local").alias("hour_local_high"),
            (-F.col("__high.neg")).alias("index_high"),
        )
    )


def monthly_context(days: DataFrame) -> DataFrame:
    """Mean temperature and mean monthly rain per site and calendar month."""
    years = F.count_distinct(F.year("date_local"))
    return days.groupBy("city", F.month("date_local").alias("month")).agg(
        F.avg("temperature_avg_c").alias("temperature_c"),
        F.try_divide(F.sum("precipitation_mm"), years).alias("rain_mm"),
    )


def timeline(typical: DataFrame) -> DataFrame:
    """Earliest start, latest end and span of peaks per species over the sites."""
    return typical.groupBy("pollen_type").agg(
        F.min("start_doy").alias("start"),
        F.max("end_doy").alias("end"),
        F.min("peak_doy").alias("peak_from"),
        F.max("peak_doy").alias("peak_to"),
    )


def season_headline(
    typical: DataFrame, profile: DataFrame, flags: DataFrame, n_sites: int | None = None
) -> DataFrame:
    """Per species over all sites: median typical start and peak, cleanest hour, high days a year.

    High days are the flagged days divided by the number of years and of sites.
    """
    key = ["pollen_type"]
    dates = quantiles(
        typical, key, {"start_doy": {"start_doy": 0.5}, "peak_doy": {"peak_doy": 0.5}}
    )
    hour = lowest_hour(mean_profile(profile), ["pollen_type"]).select(
        "pollen_type", F.col("hour_local").alias("cleanest_hour")
    )
    names = {c.removeprefix("high_"): c for c in flags.columns if c.startswith("high_") and c != "high_any"}
    # Per site and year first: two distinct counts over the days would multiply the days.
    per_site_year = flags.groupBy("city", "year").agg(
        *[F.sum(F.col(c).cast("int")).alias(s) for s, c in names.items()]
    )
    sites = F.count_distinct("city") if n_sites is None else F.max(F.lit(n_sites))
    totals = per_site_year.agg(
        F.count_distinct("year").alias("__years"),
        sites.alias("__sites"),
        *[F.sum(s).cast("double").alias(s) for s in names],
    )
    per_year = unpivot(
        totals.select(
            *[
                F.try_divide(F.try_divide(F.col(s), F.col("__years")), F.col("__sites")).alias(s)
                for s in names
            ]
        ),
        [],
        {s: s for s in names},
        "pollen_type",
        "high_days_per_year",
        True,
    )
    return dates.join(hour, key).join(per_year, key)


def data_coverage(days: DataFrame) -> DataFrame:
    """Number of sites, first and last day."""
    return days.agg(
        F.count_distinct("city").alias("n_cities"),
        F.min("date_local").alias("first_day"),
        F.max("date_local").alias("last_day"),
    )


def season_days(
    days: DataFrame, seasons: DataFrame, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Daily rows inside each season with ``grains`` and ``ratio`` to that season's mean."""
    columns = columns or daily_columns()
    wanted = seasons.filter(F.col("pollen_type").isin(list(columns)))
    rows = in_season(days, wanted).withColumn("grains", pick("pollen_type", columns))
    season_mean = F.avg("grains").over(Window.partitionBy("city", "year", "pollen_type"))
    return rows.withColumn("ratio", F.try_divide(F.col("grains"), season_mean)).withColumn(
        "pollen_type", F.initcap("pollen_type")
    )
