"""Data rules. Each rule returns the rows that break it; no rows = pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import epoch_hours
from stationlake.model import SITES, SPECIES


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def outside(column: str, lo: float | None = None, hi: float | None = None) -> Column:
    """Outside the closed range; an unknown value passes."""
    parts = []
    if lo is not None:
        parts.append(F.col(column) < F.lit(lo))
    if hi is not None:
        parts.append(F.col(column) > F.lit(hi))
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def in_range(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    return df.filter(outside(column, lo, hi))


def not_negative(df: DataFrame, column: str) -> DataFrame:
    return in_range(df, column, lo=0)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Known values that are not in the list."""
    return df.filter(~F.col(column).isin(list(values)))


def missing_days(days: DataFrame) -> DataFrame:
    """Days without a row between the first and the last day of each site."""
    bounds = days.groupBy("city").agg(
        F.min("date_local").alias("first"), F.max("date_local").alias("last")
    )
    expected = bounds.select("city", F.explode(F.sequence("first", "last")).alias("date_local"))
    return expected.join(days.select("city", "date_local"), ["city", "date_local"], "left_anti")


def hour_counts(hours: DataFrame, time: str = "time_utc") -> DataFrame:
    """First and last hour, number of rows and of expected rows per site."""
    span = epoch_hours(F.max(time)) - epoch_hours(F.min(time)) + 1
    return hours.groupBy("city").agg(
        F.min(time).alias("first_hour"),
        F.max(time).alias("last_hour"),
        F.count(F.lit(1)).alias("n_hours"),
        span.alias("expected_hours"),
    )


def missing_hours(hours: DataFrame, time: str = "time_utc") -> DataFrame:
    """Sites whose number of rows differs from the hours of their span."""
    counts = hour_counts(hours, time).filter(F.col("n_hours") != F.col("expected_hours"))
    return counts.select("city", "n_hours", "expected_hours")


def disordered_seasons(seasons: DataFrame) -> DataFrame:
    return seasons.filter(F.col("season_start") > F.col("season_end"))


def freshness(
    sources: Mapping[str, DataFrame], now: Column, time: str = "time", warn_days: int = 2, error_days: int = 4
) -> DataFrame:
    """Age of the newest row per source and whether it passes, warns or fails."""
    def of(name: str, df: DataFrame) -> DataFrame:
        newest = df.agg(F.max(time).alias("newest"))
        age = F.timestamp_diff("SECOND", F.col("newest"), now)
        day = 86400
        status = (
            F.when(F.col("newest").isNull() | (age > error_days * day), "error")
            .when(age > warn_days * day, "warn")
            .otherwise("pass")
        )
        return newest.select(F.lit(name).alias("source"), "newest", status.alias("status"))

    return reduce(DataFrame.unionByName, [of(n, df) for n, df in sources.items()])


def missing_report(missing: DataFrame) -> DataFrame:
    """Mean percentage of missing values per source, variable and year, only where there are any."""
    return (
        missing.filter(F.col("pct_missing") > 0)
        .groupBy("source", "variable", "year")
        .agg(F.round(F.avg("pct_missing"), 1).alias("pct_missing"))
    )


@dataclass(frozen=True)
class RowRule:
    """A rule that one row can break on its own."""

    name: str
    broken: Column


@dataclass(frozen=True)
class KeyRule:
    """The columns that must be unique together."""

    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique({', '.join(self.columns)})"


def null_rule(column: str) -> RowRule:
    return RowRule(f"not_null({column})", F.col(column).isNull())


def range_rule(column: str, lo: float | None = None, hi: float | None = None) -> RowRule:
    return RowRule(f"in_range({column}, {lo}, {hi})", outside(column, lo, hi))


def negative_rule(column: str) -> RowRule:
    return RowRule(f"not_negative({column})", outside(column, lo=0))


def values_rule(column: str, values: Sequence) -> RowRule:
    broken = F.coalesce(~F.col(column).isin(list(values)), F.lit(False))
    return RowRule(f"accepted_values({column})", broken)


@dataclass(frozen=True)
class SiteRule:
    """A rule on the keys of a whole site: violations of one site, from aggregates of its rows.

    ``found`` are the aggregates wanted, by name, over one row per key that has
    the key columns and ``__n``, its number of rows; ``violations`` is computed
    from them and the site.
    """

    name: str
    site: str
    found: Mapping[str, Column]
    violations: Column


def days_rule(site: str = "city", day: str = "date_local") -> SiteRule:
    """As ``missing_days``, for a table with the key (site, day)."""
    span = F.date_diff("__last", "__first") + 1
    found = {"__first": F.min(day), "__last": F.max(day), "__days": F.count(day)}
    return SiteRule("no_missing_days", site, found, F.when(F.col(site).isNull(), span).otherwise(span - F.col("__days")))


def hours_rule(site: str = "city", time: str = "time_utc") -> SiteRule:
    """As ``missing_hours``, for a table with the key (site, time): 1 for each site."""
    found = {"__span": epoch_hours(F.max(time)) - epoch_hours(F.min(time)) + 1, "__rows": F.sum("__n")}
    return SiteRule("no_missing_hours", site, found, F.when(F.col("__rows") != F.col("__span"), 1))


def order_rule() -> RowRule:
    """As ``disordered_seasons``."""
    return RowRule("start_not_after_end", F.coalesce(F.col("season_start") > F.col("season_end"), F.lit(False)))


Rule = RowRule | KeyRule | SiteRule


def run_rules(table: str, df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Number of violations per rule.

    The table is read once: rows are reduced to its first key with the number of
    rows and of violations of every row rule, the keys to sites where a rule asks
    for them, and these to one row. A further key is one more aggregation.
    """
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    site_rules = [r for r in rules if isinstance(r, SiteRule)]
    keys = [r for r in rules if isinstance(r, KeyRule)]
    sites = {r.site for r in site_rules}
    if sites and (len(sites) > 1 or not keys or not sites <= set(keys[0].columns)):
        raise ValueError(f"{table}: rules on sites need one site column, part of the first key")
    broken = [F.count(F.when(r.broken, 1)).alias(f"__r{i}") for i, r in enumerate(row_rules)]
    counts = {r.name: f"__r{i}" for i, r in enumerate(row_rules)}
    found = df.groupBy(*keys[0].columns).agg(F.count(F.lit(1)).alias("__n"), *broken) if keys else df.agg(*broken)
    if keys:
        found = found.withColumn("__copies", (F.col("__n") > 1).cast("long"))
        counts[keys[0].name] = "__copies"
    for site in sites:
        mine = {f"__s{i}": r for i, r in enumerate(site_rules)}
        wanted = {n: c for r in mine.values() for n, c in r.found.items()}
        sums = [F.sum(c).alias(c) for c in counts.values()]
        found = found.groupBy(site).agg(*[c.alias(n) for n, c in wanted.items()], *sums)
        found = found.withColumns({n: r.violations.cast("long") for n, r in mine.items()})
        counts |= {r.name: n for n, r in mine.items()}
    totals = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.values()])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(c).alias("violations")) for name, c in counts.items()]
    parts = [totals.select(F.lit(table).alias("table"), F.inline(F.array(*entries)))]
    for rule in keys[1:]:
        doubles = unique_combination(df, rule.columns).agg(F.count(F.lit(1)).alias("violations"))
        parts.append(doubles.select(F.lit(table).alias("table"), F.lit(rule.name).alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def rule_sets(
    sites: Sequence[str] = tuple(s[0] for s in SITES),
    species: Sequence[str] = tuple(SPECIES),
    hours_per_day: tuple[int, int] = (23, 25),
) -> dict[str, list[Rule]]:
    """The rules of every table of the pipeline."""
    air = [f"{s}_pollen" for s in species] + ["pm2_5", "pm10", "ozone", "no2"]
    return {
        "air_quality": [KeyRule(("city", "time"))],
        "weather": [KeyRule(("city", "time"))],
        "stg_air_quality": [
            KeyRule(("city", "time_utc")),
            null_rule("city"),
            values_rule("city", sites),
            null_rule("time_utc"),
            null_rule("time_local"),
            *[null_rule(c) for c in air],
            *[negative_rule(c) for c in air],
        ],
        "stg_weather": [
            KeyRule(("city", "time_utc")),
            null_rule("city"),
            null_rule("time_utc"),
            null_rule("temperature_c"),
            range_rule("temperature_c", -50, 40),
            null_rule("humidity_pct"),
            range_rule("humidity_pct", 0, 100),
            null_rule("precipitation_mm"),
            negative_rule("precipitation_mm"),
            null_rule("wind_speed_kmh"),
            negative_rule("wind_speed_kmh"),
            null_rule("wind_direction_deg"),
            range_rule("wind_direction_deg", 0, 360),
        ],
        "hourly": [
            KeyRule(("city", "time_utc")),
            range_rule("hour_local", 0, 23),
            null_rule("temperature_c"),
            hours_rule(),
        ],
        "daily": [
            KeyRule(("city", "date_local")),
            days_rule(),
            range_rule("n_hours", *hours_per_day),
        ],
        "weekly": [
            KeyRule(("city", "iso_year", "iso_week")),
            range_rule("n_days", 1, 7),
        ],
        "seasons": [
            KeyRule(("city", "pollen_type", "year")),
            values_rule("pollen_type", species),
            null_rule("season_start"),
            null_rule("peak_date"),
            null_rule("season_end"),
            order_rule(),
        ],
    }


def run_suite(tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[Rule]]) -> DataFrame:
    """All rules of all given tables, each table read once."""
    return reduce(DataFrame.unionByName, [run_rules(name, df, rules[name]) for name, df in tables.items() if name in rules])
