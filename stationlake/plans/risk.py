"""High days, allergy calendars and days that combine high counts with bad air."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import iso_week
from stationlake.functions.conditions import any_above, known, share
from stationlake.model import CAUSES, HIGH, MODERATE, OZONE_LIMIT, PM25_LIMIT, daily_columns
from stationlake.operators.neighbours import rolling_mean
from stationlake.operators.runs import as_ranges
from stationlake.plans.climatology import daily_flags


def risk_calendar(
    flags: DataFrame, first_week: int = 10, last_week: int = 38, by_year: bool = False
) -> DataFrame:
    """Share of high days per site and ISO week, optionally per calendar year."""
    keys = ["city", "year", "week"] if by_year else ["city", "week"]
    return (
        flags.filter(F.col("week").between(first_week, last_week))
        .groupBy(*keys)
        .agg(share(F.col("high_any")).alias("high_any"))
    )


def allergy_calendar(
    days: DataFrame,
    columns: Mapping[str, str] | None = None,
    high: Mapping[str, float] = HIGH,
    moderate: float = MODERATE,
    first_week: int = 10,
    last_week: int = 38,
) -> DataFrame:
    """Share of days per site, ISO week and level ('High pollen', 'Moderate or high pollen')."""
    columns = columns or daily_columns()
    week = days.select("city", iso_week("date_local").alias("week"), *columns.values())
    levels = {
        "High pollen": any_above(columns, high),
        "Moderate or high pollen": any_above(columns, moderate),
    }
    return (
        week.filter(F.col("week").between(first_week, last_week))
        .groupBy("city", "week")
        .agg(*[share(c).alias(name) for name, c in levels.items()])
        .unpivot(["city", "week"], list(levels), "level", "share")
    )


def safe_weeks(
    calendar: DataFrame,
    first_week: int = 14,
    last_week: int = 35,
    below: float = 0.05,
    level: str = "High pollen",
) -> DataFrame:
    """Per site, the weeks with practically no high days as text ranges."""
    safe = calendar.filter(
        (F.col("level") == level)
        & F.col("week").between(first_week, last_week)
        & (F.col("share") < below)
    )
    return as_ranges(safe, ["city"], "week", "weeks")


def rolling_daily_max(
    hours: DataFrame, value: str = "ozone", rows: int = 8, result: str = "ozone_8h_max"
) -> DataFrame:
    """Highest 8-row mean per site and local day; the mean reaches over midnight."""
    narrow = hours.select("city", "time_utc", "date_local", value)
    rolled = rolling_mean(narrow, ["city"], "time_utc", value, rows, "__rolling")
    return rolled.groupBy("city", "date_local").agg(F.max("__rolling").alias(result))


def risk_days(
    days: DataFrame,
    hours: DataFrame,
    columns: Mapping[str, str] | None = None,
    levels: Mapping[str, float] = HIGH,
    ozone_limit: float = OZONE_LIMIT,
    pm25_limit: float = PM25_LIMIT,
    causes: Sequence[str] = CAUSES,
) -> DataFrame:
    """Daily rows with bad-air flags, ``both`` = high count and bad air, and the cause.

    Ozone names the cause where both limits are exceeded.
    """
    ozone = rolling_daily_max(hours)
    flags = daily_flags(days, columns, levels).select(
        "city", "date_local", "pm2_5_avg", "high_any", "year", "month"
    )
    bad_ozone = known(F.col("ozone_8h_max") > ozone_limit)
    bad_pm25 = known(F.col("pm2_5_avg") > pm25_limit)
    return (
        flags.join(ozone, ["city", "date_local"])
        .withColumns({"bad_ozone": bad_ozone, "bad_pm25": bad_pm25})
        .withColumn("both", F.col("high_any") & (F.col("bad_ozone") | F.col("bad_pm25")))
        .withColumn(
            "cause", F.when(F.col("bad_ozone"), F.lit(causes[0])).otherwise(F.lit(causes[1]))
        )
    )


def risk_headline(risk: DataFrame) -> DataFrame:
    """Number of high days, bad-air days, days with both, and both by cause."""
    def count(condition):
        return F.sum(condition.cast("long"))

    both, ozone, pm25 = F.col("both"), F.col("bad_ozone"), F.col("bad_pm25")
    return risk.agg(
        count(F.col("high_any")).alias("high_days"),
        count(ozone | pm25).alias("bad_air_days"),
        count(both).alias("both_days"),
        count(both & ozone).alias("both_ozone"),
        count(both & pm25).alias("both_pm25"),
    )


def risk_by_year(risk: DataFrame, n_sites: int = 1) -> DataFrame:
    """Days with both per year, divided by the number of sites."""
    return risk.groupBy("year").agg(
        (F.sum(F.col("both").cast("int")) / F.lit(float(n_sites))).alias("risk_days")
    )


def risk_by_site_year(risk: DataFrame) -> DataFrame:
    return risk.groupBy("city", "year").agg(F.sum(F.col("both").cast("long")).alias("both"))


def risk_per_year(risk: DataFrame, n_sites: int = 1) -> DataFrame:
    """One figure: days with both, per year with data and per site."""
    return risk.agg(
        F.try_divide(
            F.sum(F.col("both").cast("int")),
            F.count_distinct("year") * F.lit(n_sites),
        ).alias("risk_per_year")
    )


def risk_by_month(
    risk: DataFrame,
    first_month: int = 3,
    last_month: int = 9,
    causes: Sequence[str] = CAUSES,
) -> DataFrame:
    """Days with both per month, one column per cause; months without any are 0.

    A zero row per month goes into the same aggregation, so no join is needed
    to fill the gaps.
    """
    spark = risk.sparkSession
    empty = spark.range(first_month, last_month + 1).select(
        F.col("id").cast("int").alias("month"), F.lit(None).cast("string").alias("cause")
    )
    hits = risk.filter(F.col("both")).select("month", "cause")
    return (
        hits.filter(F.col("month").between(first_month, last_month))
        .unionByName(empty)
        .groupBy("month")
        .agg(*[F.count(F.when(F.col("cause") == c, 1)).alias(c) for c in causes])
    )
