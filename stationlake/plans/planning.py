"""Stock, travel, event and retail planning from seasons and daily flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import half_month, iso_week, weeks_between
from stationlake.functions.conditions import any_above, known, share
from stationlake.model import (
    FACTOR_AIR,
    FACTOR_HOT,
    FACTOR_RAIN,
    HOT_C,
    MODERATE,
    PM25_LIMIT,
    RAINY_MM,
    daily_columns,
)
from stationlake.operators.order_stats import quantiles
from stationlake.operators.reshape import grid, labelled
from stationlake.operators.runs import ratio_to_mean, top_rows

DAYS_PER_MONTH = 30.4


def stock_plan(seasons: DataFrame) -> DataFrame:
    """Per species and site: stock-ready week, typical weeks and mean yearly sum.

    Stock is ready one week before the 10 % quantile of the start weeks,
    rounded half to even. A group holds one row per year.
    """
    week = F.col("start_week").cast("double")
    return (
        seasons.withColumn("pollen_type", F.initcap("pollen_type"))
        .groupBy("pollen_type", "city")
        .agg(
            F.percentile(week, F.lit(0.1)).alias("earliest_start"),
            F.median("start_week").alias("typical_start"),
            F.median("peak_week").alias("typical_peak"),
            F.median("end_week").alias("typical_end"),
            F.avg("year_total").alias("yearly_pollen"),
        )
        .withColumn("stock_ready_week", F.bround(F.col("earliest_start") - 1).cast("int"))
    )


def stock_headline(plan: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per species over all sites: first site to be ready, median peak, largest gap, mean sum."""
    key = ["pollen_type"]
    first = plan.groupBy(*key).agg(
        F.min(F.struct("stock_ready_week", "city")).alias("__first"),
        F.avg("yearly_pollen").alias("yearly_pollen"),
    )
    parts = [
        first.select(
            *key,
            F.col("__first.city").alias("first_city"),
            F.col("__first.stock_ready_week").alias("first_ready_week"),
            "yearly_pollen",
        ),
        quantiles(plan, key, {"typical_peak": {"typical_peak": 0.5}}),
        gaps.groupBy(*key).agg(F.max("median").alias("largest_gap")),
    ]
    return reduce(lambda a, b: a.join(b, key, "left"), parts)


def data_quality(
    plan: DataFrame,
    labels: Mapping[str, str] | None = None,
    exceptions: Mapping[tuple[str, str], str] | None = None,
) -> DataFrame:
    """Label how far the data of a species (or of a species at one site) can be trusted."""
    labels = labels or {"Birch": "good", "Grass": "good", "Alder": "weak", "Mugwort": "weak"}
    exceptions = {("Alder", "Göteborg"): "ok"} if exceptions is None else exceptions
    chain = F
    for (species, city), label in exceptions.items():
        hit = (F.col("pollen_type") == species) & (F.col("city") == city)
        chain = chain.when(hit, F.lit(label))
    for species, label in labels.items():
        chain = chain.when(F.col("pollen_type") == species, F.lit(label))
    return plan.withColumn("data_quality", chain)


def season_coverage(seasons: DataFrame, first_week: int = 5, last_week: int = 36) -> DataFrame:
    """Share of years in which a week lies inside the season, per species and site."""
    weeks = F.explode(F.sequence(F.lit(first_week), F.lit(last_week)))
    return (
        seasons.select(
            F.initcap("pollen_type").alias("pollen_type"),
            "city",
            "start_week",
            "end_week",
            weeks.alias("week"),
        )
        .groupBy("pollen_type", "city", "week")
        .agg(share(F.col("week").between(F.col("start_week"), F.col("end_week"))).alias("in_season"))
    )


def start_gaps(seasons: DataFrame, reference: str = "Malmö") -> DataFrame:
    """Weeks between each site's season start and the reference site's, over the years.

    The reference side is one site: one row per species and year. Years missing
    there drop out.
    """
    starts = seasons.select(
        F.initcap("pollen_type").alias("pollen_type"), "city", "year", "season_start"
    )
    ref = starts.filter(F.col("city") == reference).select(
        "pollen_type", "year", F.col("season_start").alias("__ref")
    )
    return (
        starts.join(ref, ["pollen_type", "year"])
        .withColumn("gap_weeks", weeks_between("__ref", "season_start"))
        .groupBy("pollen_type", "city")
        .agg(
            F.median("gap_weeks").alias("median"),
            F.min("gap_weeks").alias("earliest"),
            F.max("gap_weeks").alias("latest"),
        )
    )


def regional_gap(
    seasons: DataFrame,
    regions: DataFrame,
    species: str = "birch",
    early: str = "South",
    late: str = "North",
) -> DataFrame:
    """Whole days from the mean start of one region to that of another, per year.

    ``regions`` maps each site to its region.
    """
    starts = seasons.filter(F.col("pollen_type") == species).join(
        regions.select("city", "region"), "city"
    )

    def mean_of(region: str):
        return F.avg(F.when(F.col("region") == region, F.unix_date("season_start")))

    days = F.floor(mean_of(late) - mean_of(early)).cast("int")
    return starts.groupBy("year").agg(days.alias("gap_days")).withColumn(
        "gap_weeks", F.round(F.col("gap_days") / 7, 1)
    )


def regional_gap_summary(gaps: DataFrame) -> DataFrame:
    """Median and range over the years."""
    return gaps.agg(
        F.median("gap_days").alias("median_days"),
        F.min("gap_days").alias("min_days"),
        F.max("gap_days").alias("max_days"),
    )


def intensity(seasons: DataFrame) -> DataFrame:
    """Yearly sum as an index: 100 = the site's mean year of that species."""
    rows = seasons.select(
        "city", F.initcap("pollen_type").alias("pollen_type"), "year", "year_total"
    )
    return ratio_to_mean(rows, ["city", "pollen_type"], "year_total", "index", 100.0)


def mean_intensity(index: DataFrame) -> DataFrame:
    """Mean index over the sites per species and year."""
    return index.groupBy("pollen_type", "year").agg(F.avg("index").alias("index"))


def half_month_share(flags: DataFrame, months: Sequence[int] = (4, 5, 6)) -> DataFrame:
    """Share of high days per site and half-month of spring."""
    return (
        flags.filter(F.col("month").isin(list(months)))
        .groupBy("city", half_month("date_local").alias("period"))
        .agg(share(F.col("high_any")).alias("high_any"))
    )


def best_site_per_period(shares: DataFrame) -> DataFrame:
    """Site with the smallest share per period; the name breaks ties."""
    return (
        shares.groupBy("period")
        .agg(F.min(F.struct("high_any", "city")).alias("__best"))
        .select("period", F.col("__best.city").alias("city"), F.col("__best.high_any").alias("high_any"))
    )


def spring_share(flags: DataFrame, months: Sequence[int] = (4, 5, 6)) -> DataFrame:
    """Share of high days over the whole spring per site."""
    return (
        flags.filter(F.col("month").isin(list(months)))
        .groupBy("city")
        .agg(share(F.col("high_any")).alias("high_any"))
    )


def event_days(
    days: DataFrame,
    risk: DataFrame,
    columns: Mapping[str, str] | None = None,
    first_week: int = 14,
    last_week: int = 38,
    level: float = MODERATE,
) -> DataFrame:
    """Daily rows of the event weeks with the flags pollen, rain, bad air, hot and problem."""
    columns = columns or daily_columns()
    narrow = days.select(
        "city",
        "date_local",
        iso_week("date_local").alias("week"),
        any_above(columns, level).alias("pollen"),
        known(F.col("precipitation_mm") >= RAINY_MM).alias("rain"),
        known(F.col("temperature_max_c") >= HOT_C).alias("hot"),
    ).filter(F.col("week").between(first_week, last_week))
    air = risk.select(
        "city", "date_local", (F.col("bad_ozone") | F.col("bad_pm25")).alias("bad_air")
    )
    return narrow.join(air, ["city", "date_local"]).withColumn(
        "problem", F.col("pollen") | F.col("rain") | F.col("bad_air")
    )


FACTORS = {"rain": FACTOR_RAIN, "bad_air": FACTOR_AIR, "hot": FACTOR_HOT}


def event_factors(flagged: DataFrame) -> DataFrame:
    """Share of days per week and factor, all site-days pooled."""
    shares = flagged.groupBy("week").agg(*[share(F.col(c)).alias(c) for c in FACTORS])
    return shares.select("week", _factor_rows())


def _factor_rows():
    return labelled({label: F.col(c) for c, label in FACTORS.items()}, "factor", "share")


def event_factors_site_mean(flagged: DataFrame) -> DataFrame:
    """Mean over the sites of each site's share; differs when sites have unequal days."""
    per_site = flagged.groupBy("city", "week").agg(
        *[share(F.col(c)).alias(c) for c in FACTORS]
    )
    means = per_site.groupBy("week").agg(*[F.avg(c).alias(c) for c in FACTORS])
    return means.select("week", _factor_rows())


def event_risk(flagged: DataFrame) -> DataFrame:
    """Share of problem days per site and week."""
    return flagged.groupBy("city", "week").agg(share(F.col("problem")).alias("problem"))


def best_and_worst_week(
    shares: DataFrame, best: tuple[int, int] = (18, 35), worst: tuple[int, int] = (14, 35)
) -> DataFrame:
    """Weeks with the smallest and largest mean share over the sites; ties: earlier week."""
    weeks = shares.groupBy("week").agg(F.avg("problem").alias("problem"))
    low = F.when(F.col("week").between(*best), F.struct("problem", "week"))
    high = F.when(
        F.col("week").between(*worst), F.struct((-F.col("problem")).alias("neg"), F.col("week"))
    )
    return weeks.agg(F.min(low).alias("lo"), F.min(high).alias("hi")).select(
        F.col("lo.week").alias("best_week"),
        F.col("lo.problem").alias("best_share"),
        F.col("hi.week").alias("worst_week"),
        (-F.col("hi.neg")).alias("worst_share"),
    )


def best_weeks(
    shares: DataFrame, first_week: int = 18, last_week: int = 35, k: int = 3
) -> DataFrame:
    """The k weeks with the fewest problem days per site; ties: earlier week."""
    rows = shares.filter(F.col("week").between(first_week, last_week))
    return top_rows(rows, ["city"], [F.col("problem").asc(), F.col("week").asc()], k)


def retail_need(flags: DataFrame, pm25_limit: float = PM25_LIMIT) -> DataFrame:
    """Mean days per month with high counts and with fine particles above the limit."""
    return (
        flags.groupBy("city", "month")
        .agg(
            share(F.col("high_any")).alias("high_any"),
            share(F.col("pm2_5_avg") > pm25_limit).alias("bad_pm25"),
        )
        .withColumns(
            {
                "high_days": F.col("high_any") * F.lit(DAYS_PER_MONTH),
                "pm25_days": F.col("bad_pm25") * F.lit(DAYS_PER_MONTH),
            }
        )
    )


def pm25_days_per_year(days: DataFrame, pm25_limit: float = PM25_LIMIT) -> DataFrame:
    """Days per year above the limit, per site, one decimal."""
    yearly = share(F.col("pm2_5_avg") > pm25_limit) * F.lit(365)
    return days.groupBy("city").agg(F.round(yearly, 1).alias("days_per_year"))


def retail_headline(need: DataFrame) -> DataFrame:
    """Peak month of high days, peak month of particle days, site with most particle days.

    Ties go to the earlier month and to the first name.
    """
    months = need.groupBy("month").agg(
        F.avg("high_days").alias("__high"), F.avg("pm25_days").alias("__pm25")
    )
    top = months.agg(
        F.min(F.struct((-F.col("__high")).alias("v"), F.col("month"))).alias("h"),
        F.min(F.struct((-F.col("__pm25")).alias("v"), F.col("month"))).alias("p"),
    )
    site = (
        need.groupBy("city")
        .agg(F.sum("pm25_days").alias("__pm25"))
        .agg(F.min(F.struct((-F.col("__pm25")).alias("v"), F.col("city"))).alias("s"))
        .select(F.col("s.city"))
    )
    return top.select(
        F.col("h.month").alias("peak_month"),
        F.col("p.month").alias("pm25_month"),
        site.scalar().alias("pm25_city"),
    )


def season_grid(seasons: DataFrame, sites: Sequence[str], cell: str = "season_days") -> DataFrame:
    """One row per species and year, one column per site in the given order; null where a site had no season.

    The columns are named beforehand, so no job looks for them and a site
    without any season has its column.
    """
    return grid(seasons, ["pollen_type", "year"], "city", sites, cell)
