"""Correlations, season drivers, campaign triggers, model validation, sample sizes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import days_between, doy_to_date, fixed_date
from stationlake.functions.conditions import share
from stationlake.model import daily_columns
from stationlake.operators.order_stats import spearman
from stationlake.operators.runs import run_ends
from stationlake.plans.climatology import in_season
from stationlake.plans.marts import cumulative_seasons

CORRELATED = [
    "birch_pollen_avg", "pm2_5_avg", "ozone_avg", "no2_avg",
    "temperature_max_c", "humidity_avg_pct", "precipitation_mm", "wind_speed_avg_kmh",
]
DRIVERS = ["prev_summer_temp", "spring_temp", "season_temp", "season_rain_days"]


def spearman_matrix(days: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Lower triangle of the rank correlation matrix, pairwise complete."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    return spearman(days, [], pairs).select("var1", "var2", "rho", "n")


def spearman_by_species(
    drivers: DataFrame, value: str = "index", against: Sequence[str] = DRIVERS
) -> DataFrame:
    """Rank correlation of the intensity index with each driver, per species."""
    result = spearman(drivers, ["pollen_type"], [(value, d) for d in against])
    return result.select("pollen_type", F.col("var2").alias("driver"), "rho", "n")


def season_drivers(intensity: DataFrame, days: DataFrame, seasons: DataFrame) -> DataFrame:
    """Intensity with the weather that may explain it, one row per site, species and year.

    Previous summer (June and July a year earlier), spring (March to May), mean
    temperature and share of rainy days inside the season.
    """
    weather = days.select("city", "date_local", "temperature_avg_c", "precipitation_mm")
    month, temp = F.month("date_local"), F.col("temperature_avg_c")
    yearly = weather.groupBy("city", F.year("date_local").alias("year")).agg(
        F.avg(F.when(month.isin(6, 7), temp)).alias("summer_temp"),
        F.avg(F.when(month.isin(3, 4, 5), temp)).alias("spring_temp"),
        F.sum(month.isin(3, 4, 5).cast("int")).alias("__spring_days"),
    )
    previous = yearly.select(
        "city", (F.col("year") + 1).alias("year"), F.col("summer_temp").alias("prev_summer_temp")
    )
    spring = yearly.filter(F.col("__spring_days") > 0).select("city", "year", "spring_temp")
    inside = (
        in_season(weather, seasons)
        .groupBy("city", F.initcap("pollen_type").alias("pollen_type"), "year")
        .agg(
            F.avg("temperature_avg_c").alias("season_temp"),
            share(F.col("precipitation_mm") >= 1).alias("season_rain_days"),
        )
    )
    return (
        intensity.join(previous, ["city", "year"], "left")
        .join(spring, ["city", "year"])
        .join(inside, ["city", "pollen_type", "year"])
    )


def campaign_trigger(
    days: DataFrame,
    column: str = "birch_pollen_avg",
    level: float = 10.0,
    run: int = 3,
    first_month: int = 2,
) -> DataFrame:
    """Per site and year, the first day of ``run`` rows in a row above the level.

    Starts in February; null where the rule never fires. The day is counted
    back from the row that completes the run by ``run - 1`` calendar days. A
    series is one site and year: at most 366 rows.
    """
    rows = days.select("city", "date_local", column, F.year("date_local").alias("year")).filter(
        F.month("date_local") >= first_month
    )
    ends = run_ends(
        rows, ["city", "year"], "date_local", F.col(column) > level, run, short=True
    )
    fired = ends.groupBy("city", "year").agg(F.min("date_local").alias("__end"))
    series = rows.select("city", "year").distinct()
    return series.join(fired, ["city", "year"], "left").select(
        "city", "year", F.date_sub("__end", run - 1).alias("trigger")
    )


def trigger_vs_fixed(
    triggers: DataFrame,
    seasons: DataFrame,
    species: str = "birch",
    labels: tuple[str, str] = ("Pollen trigger", "Fixed date (1 April)"),
) -> DataFrame:
    """Days between each campaign start and the real season start, long form."""
    starts = seasons.filter(F.col("pollen_type") == species).select("city", "year", "season_start")
    timing = triggers.join(starts, ["city", "year"]).select(
        "city",
        "year",
        days_between("season_start", "trigger").alias(labels[0]),
        days_between("season_start", fixed_date("year")).alias(labels[1]),
    )
    return timing.unpivot(["city", "year"], list(labels), "campaign_start", "days_vs_season")


def trigger_summary(comparison: DataFrame) -> DataFrame:
    """Median per method and site over the years."""
    return comparison.groupBy("campaign_start", "city").agg(
        F.median("days_vs_season").alias("median_days")
    )


def trend_adjusted(measured: DataFrame, year: int = 2023) -> DataFrame:
    """Measured means moved along their linear trend to ``year``."""
    shift = F.lit(float(year)) - (F.col("first_year") + F.col("last_year")) / F.lit(2.0)
    return measured.select(
        "pollen_type",
        *[
            (F.col(c) + F.col(f"{c}_trend") * shift).alias(c)
            for c in ("start", "peak", "end", "spin")
        ],
    )


def model_seasons(
    days: DataFrame,
    site: str | None = None,
    columns: Mapping[str, str] | None = None,
    lo: float = 0.03,
    hi: float = 0.97,
) -> DataFrame:
    """Mean day of year of start, peak and end and mean yearly sum per species."""
    rows = days if site is None else days.filter(F.col("city") == site)
    return (
        cumulative_seasons(rows, columns or daily_columns(), lo, hi)
        .groupBy(F.initcap("pollen_type").alias("pollen_type"))
        .agg(
            F.avg(F.dayofyear("season_start")).alias("start"),
            F.avg(F.dayofyear("peak_date")).alias("peak"),
            F.avg(F.dayofyear("season_end")).alias("end"),
            F.avg("year_total").alias("spin"),
        )
    )


def model_vs_measured(model: DataFrame, measured: DataFrame, year: int = 2023) -> DataFrame:
    """Dates of both sides, difference in whole days (half to even) and ratio of the sums."""
    m = trend_adjusted(measured, year)
    joined = model.alias("a").join(m.alias("b"), "pollen_type")
    dates = []
    for c in ("start", "peak", "end"):
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        dates += [
            doy_to_date(b, year).alias(f"{c}_measured"),
            doy_to_date(a, year).alias(f"{c}_model"),
            F.bround(a - b).cast("int").alias(f"{c}_diff_days"),
        ]
    ratio = F.bround(F.try_divide(F.col("a.spin"), F.col("b.spin")), 2)
    return joined.select("pollen_type", *dates, ratio.alias("amount_ratio"))


def sample_size(
    units: DataFrame,
    strata: Sequence[str],
    value: str,
    before: str,
    lifts: Sequence[float] = (0.03, 0.05, 0.10, 0.15),
    z_alpha: float = 1.96,
    z_power: float = 0.84,
) -> DataFrame:
    """Units needed per group to detect a relative lift, per stratum.

    The variation and the correlation with the period before are measured on
    the units; the second figure uses the correlation to reduce the variance.
    """
    stats = units.groupBy(*strata).agg(
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"),
        F.corr(value, before).alias("rho"),
    )
    lift = F.explode(F.array(*[F.lit(float(x)) for x in lifts]))
    base = (
        F.lit(2 * (z_alpha + z_power) ** 2) * F.pow("cv", F.lit(2)) / F.pow("lift", F.lit(2))
    )
    reduced = base * (1 - F.pow("rho", F.lit(2)))
    return stats.withColumn("lift", lift).select(
        *strata,
        "lift",
        "cv",
        "rho",
        F.bround(base).cast("long").alias("per_group"),
        F.bround(reduced).cast("long").alias("per_group_adjusted"),
    )
