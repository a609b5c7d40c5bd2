"""Flags, bins and species-dependent picks as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(condition: Column) -> Column:
    """A condition in which an unknown value counts as false."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def above(columns: Mapping[str, str], levels: Mapping[str, float] | float) -> dict[str, Column]:
    """Per species: value strictly above its level, null counting as false."""
    level = levels if isinstance(levels, Mapping) else {s: levels for s in columns}
    return {s: known(F.col(c) > F.lit(float(level[s]))) for s, c in columns.items()}


def any_above(columns: Mapping[str, str], levels: Mapping[str, float] | float) -> Column:
    return any_of(list(above(columns, levels).values()))


def pick(selector: Column | str, columns: Mapping[str, str]) -> Column:
    """The value of the column that belongs to the species named by ``selector``."""
    sel = F.col(selector) if isinstance(selector, str) else selector
    chain = None
    for name, column in columns.items():
        chain = (F if chain is None else chain).when(sel == F.lit(name), F.col(column))
    return chain


def right_closed_bin(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (lo, hi] that holds the value; null outside all of them."""
    v = F.col(value) if isinstance(value, str) else value
    chain = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (v > F.lit(float(lo))) & (v <= F.lit(float(hi)))
        chain = (F if chain is None else chain).when(hit, F.lit(label))
    return chain


def bin_order(value: Column | str, edges: Sequence[float]) -> Column:
    """Position of the same interval, for sorting."""
    return right_closed_bin(value, edges, [str(i) for i in range(len(edges) - 1)]).cast("int")


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; unknown counts as not holding."""
    return F.avg(known(condition).cast("double"))


def one_site(df: DataFrame, site: str | None, key: str = "city") -> DataFrame:
    """Rows of one site, or of all sites when ``site`` is None."""
    return df if site is None else df.filter(F.col(key) == F.lit(site))
