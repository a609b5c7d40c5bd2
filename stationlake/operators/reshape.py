"""Wide <-> long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    columns: Mapping[str, str],
    name: str,
    value: str,
    keep_null: bool = False,
) -> DataFrame:
    """One row per id and column, labelled by the keys of ``columns``.

    Rows without a value are dropped unless ``keep_null`` is set.
    """
    wide = df.select(*ids, *[F.col(c).cast("double").alias(n) for n, c in columns.items()])
    long = wide.unpivot(list(ids), list(columns), name, value)
    return long if keep_null else long.filter(F.col(value).isNotNull())


def labelled(values: Mapping[str, Column], name: str, value: str) -> Column:
    """Generator: one (label, value) row per entry, for labels that are no plain column names."""
    entries = [F.struct(F.lit(n).alias(name), v.alias(value)) for n, v in values.items()]
    return F.inline(F.array(*entries))


def grid(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence, cell: str
) -> DataFrame:
    """Pivot with explicit column values, so no extra job looks for them; absent cells are null."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(cell, ignorenulls=True))


def all_except(df: DataFrame, *names: str) -> list[str]:
    """Column names without the given ones."""
    return [c for c in df.columns if c not in names]
