"""Column profiles and distributions of whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.operators.order_stats import quantiles
from stationlake.operators.reshape import labelled


def describe(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    percentiles: Sequence[float] = (0.5, 0.75, 0.9, 0.99),
    at_least: float | None = None,
    approximate: bool = False,
    rescan: bool = False,
) -> DataFrame:
    """Count, mean, deviation, extremes and percentiles per group.

    Percentiles are exact; ``approximate`` takes the sketch instead, which needs
    no second pass. ``rescan`` suits rows that come straight from a table, see
    ``quantiles``.
    """
    rows = df if at_least is None else df.filter(F.col(value) >= at_least)
    if not groups:
        whole = rows.withColumn("__all", F.lit(0))
        return describe(whole, ["__all"], value, percentiles, None, approximate, rescan).drop("__all")
    names = {f"p{round(q * 100)}": q for q in percentiles}
    basic = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    if approximate:
        sketch = [F.percentile_approx(value, q).alias(n) for n, q in names.items()]
        return rows.groupBy(*groups).agg(*basic, *sketch)
    found = quantiles(rows, groups, {value: names}, rescan).withColumnsRenamed({g: f"__{g}" for g in groups})
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups])
    return rows.groupBy(*groups).agg(*basic).join(found, same, "left").drop(*[f"__{g}" for g in groups])


def column_profile(df: DataFrame, columns: Sequence[str], rescan: bool = False) -> DataFrame:
    """Minimum, maximum, mean, median, values and missing values of each column, one row each.

    ``rescan`` suits rows that come straight from a table, see ``quantiles``.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    long = df.select(labelled(values, "column", "value"))
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
        F.count("value").alias("n_values"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
    )
    medians = quantiles(df, [], {c: {f"m{i}": 0.5} for i, c in enumerate(columns)}, rescan)
    middle = medians.select(
        labelled({c: F.col(f"m{i}") for i, c in enumerate(columns)}, "column", "q50")
    )
    return basic.join(middle, "column", "left")


def first_valid(df: DataFrame, time: str, columns: Sequence[str]) -> DataFrame:
    """First time with a value, per column."""
    firsts = df.agg(*[F.min(F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns])
    return firsts.unpivot([], list(columns), "variable", "first_valid")


def missing_share(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str] | Mapping[str, str], digits: int = 2,
    percent: bool = False,
) -> DataFrame:
    """Share (or percentage) of missing values per group, one column per variable."""
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    scale = 100.0 if percent else 1.0
    return df.groupBy(*groups).agg(
        *[
            F.round(F.lit(scale) * F.avg(F.col(c).isNull().cast("double")), digits).alias(n)
            for n, c in names.items()
        ]
    )


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a regular expression."""
    return df.select(df.colRegex(f"`{pattern}`")).columns


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()
