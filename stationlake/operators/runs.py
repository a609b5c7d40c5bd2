"""Runs of rows, ranges of consecutive numbers, best rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.operators.neighbours import with_neighbours


def first_run(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    condition: Column,
    length: int = 3,
    result: str = "first_at",
    bucket: Column | None = None,
    short: bool = False,
) -> DataFrame:
    """First row of the first ``length`` consecutive rows of a series that meet a condition.

    One row per series that has such a run; an unknown condition counts as false.
    """
    hits = run_ends(df, keys, order, condition, length, bucket, short)
    return hits.groupBy(*keys).agg(F.min("run_start").alias(result))


def run_ends(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    condition: Column,
    length: int = 3,
    bucket: Column | None = None,
    short: bool = False,
) -> DataFrame:
    """Rows that complete a run, with ``run_start``: the order value of the run's first row."""
    flagged = df.withColumn("__hit", F.coalesce(condition, F.lit(False)))
    n = with_neighbours(
        flagged, keys, order, [order, "__hit"], before=length - 1, bucket=bucket, short=short
    )
    full = (F.size("prev") == length - 1) & F.col("__hit") & F.forall("prev", lambda r: r["__hit"])
    start = F.get("prev", F.lit(0))[order] if length > 1 else F.col(order)
    return n.filter(full).withColumn("run_start", start).drop("__hit", "prev", "next")


def as_ranges(
    df: DataFrame, keys: Sequence[str], number: str, result: str = "ranges"
) -> DataFrame:
    """Distinct whole numbers per key -> text such as '14, 20–22'.

    Meant for small number ranges (weeks of a year).
    """
    keys = list(keys)
    distinct = df.select(*keys, F.col(number).cast("int").alias("__n")).distinct()
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys).orderBy("__n"))
    ranges = (
        distinct.withColumn("__island", island)
        .groupBy(*keys, "__island")
        .agg(F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    )
    text = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo").cast("string")).otherwise(
        F.concat_ws("–", "__lo", "__hi")
    )
    listed = ranges.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("__lo"), text.alias("t")))).alias("__all")
    )
    return listed.select(*keys, F.array_join(F.col("__all.t"), ", ").alias(result))


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 3, rank: str = "rank"
) -> DataFrame:
    """The k first rows per key in the given order, which should break ties itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def ratio_to_mean(
    df: DataFrame, keys: Sequence[str], value: str, result: str, scale: float = 1.0
) -> DataFrame:
    """Value divided by its group's mean, times ``scale``; null where the mean is zero."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return df.withColumn(result, F.try_divide(F.col(value), mean) * F.lit(scale))
