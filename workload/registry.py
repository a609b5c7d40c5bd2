"""Names of the queries, their Spark functions and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Floats to six decimals: sums differ in their last digits with the order of the rows."""
    return df.select(
        *[
            F.round(f"`{f.name}`", 6).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def register(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf: rounded(function(spark, sf))
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add
