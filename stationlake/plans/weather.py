"""How rain, wind and temperature change the counts; recovery after rain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.conditions import known, right_closed_bin, share
from stationlake.model import (
    RAIN_BINS,
    TEMPERATURE_BINS,
    WEATHER_SPECIES,
    WIND_BINS,
    daily_columns,
)
from stationlake.operators.neighbours import neighbours_where
from stationlake.operators.order_stats import attached, quantiles
from stationlake.plans.climatology import in_season

WEATHER_BINS = {
    "Rain": ("precipitation_mm", RAIN_BINS),
    "Wind": ("wind_speed_avg_kmh", WIND_BINS),
    "Temperature": ("temperature_max_c", TEMPERATURE_BINS),
}


def with_weather_bins(days: DataFrame, bins: Mapping = WEATHER_BINS) -> DataFrame:
    """Season days with one label column per weather variable; null outside all bins."""
    return days.withColumns(
        {
            name: right_closed_bin(column, edges, labels)
            for name, (column, (edges, labels)) in bins.items()
        }
    )


def weather_effect(binned: DataFrame, variables: Sequence[str], min_days: int = 15) -> DataFrame:
    """Mean ratio and number of days per species, variable and bin; small groups are hidden.

    All variables are counted in one pass over the days.
    """
    entries = F.array(
        *[F.struct(F.lit(v).alias("variable"), F.col(v).alias("group")) for v in variables]
    )
    return (
        binned.select("pollen_type", "ratio", F.inline(entries))
        .filter(F.col("group").isNotNull())
        .groupBy("variable", "pollen_type", "group")
        .agg(F.avg("ratio").alias("mean"), F.count(F.lit(1)).alias("size"))
        .filter(F.col("size") >= min_days)
    )


def rainy_to_dry(binned: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mean ratio on rainy days divided by that on dry days, from the rain bins."""
    def mean_of(label: str) -> Column:
        return F.avg(F.when(F.col("Rain") == label, F.col("ratio")))

    return binned.groupBy(*groups).agg(
        F.try_divide(mean_of("Rainy"), mean_of("Dry")).alias("rain_effect")
    )


def paired_effects(
    days: DataFrame, rainy_mm: float = 2.0, dry_mm: float = 0.1
) -> DataFrame:
    """Per species and site, the mean ratio on one kind of day divided by the opposite kind.

    Rainy vs dry days; windiest vs calmest third; warmest vs coolest third.
    The cuts are exact quantiles and belong to both sides.
    """
    keys = ["pollen_type", "city"]
    cuts = quantiles(
        days,
        keys,
        {
            "wind_speed_avg_kmh": {"calm": 1 / 3, "windy": 2 / 3},
            "temperature_max_c": {"cool": 1 / 3, "warm": 2 / 3},
        },
    )
    rows = days.select(
        *keys, "ratio", "precipitation_mm", "wind_speed_avg_kmh", "temperature_max_c"
    )
    cut = attached(rows, cuts, keys)

    def mean_where(condition: Column) -> Column:
        return F.avg(F.when(condition, F.col("ratio")))

    rain, speed, temp = (
        F.col("precipitation_mm"),
        F.col("wind_speed_avg_kmh"),
        F.col("temperature_max_c"),
    )
    effects = {
        "Rain (rainy vs dry)": (rain >= rainy_mm, rain < dry_mm),
        "Wind (windy vs calm)": (speed >= F.col("windy"), speed <= F.col("calm")),
        "Temperature (warm vs cool)": (temp >= F.col("warm"), temp <= F.col("cool")),
    }
    ratios = {n: F.try_divide(mean_where(a), mean_where(b)) for n, (a, b) in effects.items()}
    wide = cut.groupBy(*keys).agg(*[r.alias(n) for n, r in ratios.items()])
    return wide.unpivot(keys, list(effects), "effect", "times")


def rain_events(
    days: DataFrame,
    seasons: DataFrame,
    columns: Mapping[str, str] | None = None,
    rain_mm: float = 2.0,
    dry_mm: float = 0.1,
    min_before: float = 1.0,
    recovered: float = 0.8,
    look_ahead: int = 7,
) -> DataFrame:
    """Rainy season days after a dry day, with drop and days until the count is back.

    ``drop`` = count on the rain day / count of the day before; ``recovery_days``
    = first of the following rows at or above ``recovered`` times the day before,
    null if none. Look-back and look-ahead count rows of the site's whole
    series; days without a row before and ``look_ahead`` rows after are skipped.
    An unknown amount of rain excludes nothing: only days known to be too dry
    (or a day before known to be wet) are left out.

    The rain conditions depend on no species, so they reduce the days before
    the join with the seasons; only the days they leave get their neighbours.
    """
    columns = columns or {s: daily_columns()[s] for s in WEATHER_SPECIES}
    base = days.select("city", "date_local", "precipitation_mm", *columns.values())
    def after_a_dry_day(day: Column, before: Column) -> Column:
        return ~known(day["precipitation_mm"] < rain_mm) & ~known(before["precipitation_mm"] >= dry_mm)

    rain_days = neighbours_where(
        base,
        ["city"],
        "date_local",
        ["precipitation_mm", *columns.values()],
        after_a_dry_day,
        before=1,
        after=look_ahead,
        bucket=F.trunc("date_local", "year"),
    ).filter((F.size("prev") == 1) & (F.size("next") == look_ahead))
    day_before = F.get("prev", F.lit(0))
    per_species = rain_days.select(
        "city",
        "date_local",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("__species"),
                        F.col(c).cast("double").alias("__value"),
                        day_before[c].cast("double").alias("__before"),
                        F.transform("next", _field(c)).alias("__after"),
                    )
                    for s, c in columns.items()
                ]
            )
        ),
    ).filter(~known(F.col("__before") < min_before))
    in_its_season = in_season(per_species, seasons, kind="pollen_type").filter(
        F.col("pollen_type") == F.col("__species")
    )
    back = F.transform("__after", lambda v: known(v >= F.lit(recovered) * F.col("__before")))
    first_back = F.array_position(back, F.lit(True)).cast("int")
    return in_its_season.select(
        "city",
        F.initcap("pollen_type").alias("pollen_type"),
        "date_local",
        F.try_divide(F.col("__value"), F.col("__before")).alias("drop"),
        F.when(first_back > 0, first_back).alias("recovery_days"),
    )


def _field(name: str):
    return lambda row: row[name].cast("double")


def rain_event_summary(events: DataFrame, within: int = 2) -> DataFrame:
    """Per species: events, median drop and recovery, shares back within two days and never.

    The medians pool all sites, so they use the exact quantiles for large groups.
    """
    key = ["pollen_type"]
    shares = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"),
        share(F.col("recovery_days") <= within).alias("recovered_within"),
        share(F.col("recovery_days").isNull()).alias("not_recovered"),
    )
    medians = quantiles(
        events, key, {"drop": {"median_drop": 0.5}, "recovery_days": {"median_recovery_days": 0.5}}
    )
    return shares.join(medians, key, "left")


def recovery_curve(
    events: DataFrame, groups: Sequence[str] = ("pollen_type",), last_day: int = 7
) -> DataFrame:
    """Share of events that are back after 0 … ``last_day`` days; n = events.

    Events are counted per recovery day before the curve's days are added.
    """
    counts = events.groupBy(*groups, "recovery_days").agg(F.count(F.lit(1)).alias("__n"))
    days = F.explode(F.sequence(F.lit(0), F.lit(last_day)))
    by_then = F.when(known(F.col("recovery_days") <= F.col("days_after_rain")), F.col("__n"))
    return (
        counts.withColumn("days_after_rain", days)
        .groupBy(*groups, "days_after_rain")
        .agg(
            F.sum("__n").alias("n"),
            F.try_divide(F.coalesce(F.sum(by_then), F.lit(0)), F.sum("__n")).alias("share"),
        )
    )


def recovery_by_site(events: DataFrame, within: int = 2, weak_below: int = 8) -> DataFrame:
    """Share back within two days per species and site, with a flag for few events."""
    return (
        events.groupBy("pollen_type", "city")
        .agg(
            F.count(F.lit(1)).alias("n"),
            share(F.col("recovery_days") <= within).alias("within_2_days"),
        )
        .withColumn("weak", F.col("n") < weak_below)
    )


def box_statistics(
    days: DataFrame, groups: Sequence[str], value: str = "grains", minimum: float = 1.0
) -> DataFrame:
    """Quartiles, whiskers and number of outliers per group, for values of at least ``minimum``.

    Whiskers reach the last value within 1.5 times the box height. A null group
    is a group like others.
    """
    groups = list(groups)
    kept = days.filter(F.col(value) >= minimum).select(*groups, value)
    box = quantiles(kept, groups, {value: {"q1": 0.25, "median": 0.5, "q3": 0.75}})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        attached(kept, box, groups)
        .groupBy(*groups, "q1", "median", "q3")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum((~inside).cast("long")).alias("outliers"),
        )
    )
