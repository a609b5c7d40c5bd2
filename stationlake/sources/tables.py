"""Stored tables: keyed replace, marts, snapshots, ledgers, forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.session import work_path
from stationlake.sources import versions

MARTS = ["hourly", "daily", "weekly", "seasons", "missing_values"]


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row per key.

    An aggregation rather than a window: copies of a key are reduced before the
    shuffle, so a key with very many copies sends one row per map task.
    """
    others = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(*version, *[c for c in others if c not in version]))
    return (
        rows.groupBy(*keys)
        .agg(newest.alias("__newest"))
        .select(*[c if c in keys else F.col(f"__newest.{c}").alias(c) for c in rows.columns])
    )


def merged(
    target: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str] = ("loaded_at",)
) -> DataFrame:
    """Target with the new rows put in by column name: an overlap replaces, never duplicates.

    Columns missing on one side are null there. A new row beats a stored one
    even where both carry the same version.
    """
    both = target.withColumn("__new", F.lit(0)).unionByName(
        new.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    return latest_per_key(both, keys, ["__new", *version]).drop("__new")


_PERIODS = {"day": "yyyyMMdd", "month": "yyyyMM"}


def upsert(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str] = ("city", "time"),
    time: str = "time",
    version: Sequence[str] = ("loaded_at",),
    by: str = "month",
    keep: int = 2,
) -> None:
    """Replace or add rows by key in a table kept in periods, a day or a month each.

    The batch is staged once. Its periods alone are read and written, to new
    folders; the version that names them is put in place last. So a load can be
    repeated after a failure, readers see the table before or after a load, and
    two loads at a time cannot both succeed unseen. The newest ``keep`` versions
    can be read. The table keeps every column any load has had; a column whose
    type changes takes the narrowest type that holds both, and periods that are
    not touched keep their files. Rows without time share one period.

    ``keys`` must have the time: a key found in another period would not be seen.
    """
    if time not in keys:
        raise ValueError(f"the keys {list(keys)} lack the time column {time!r}")
    before = versions.version(spark, path)
    columns = versions.widened(spark, before.columns, new.schema) if before else versions.widened(spark, new.schema, new.schema)
    label = F.coalesce(F.date_format(time, _PERIODS[by]), F.lit("none"))
    staged = work_path(spark, "upsert-batch")
    new.write.parquet(staged)
    batch = spark.read.schema(new.schema).parquet(staged)
    # One entry for each period of the calendar.
    touched = {r["period"] for r in batch.select(label.alias("period")).distinct().collect()}
    stored = versions.read(spark, path, before, touched) if before else None
    rows = merged(stored, batch, keys, version) if before else latest_per_key(batch, keys, version)
    try:
        versions.replace(spark, path, before, rows.withColumn("__period", label), columns, "__period")
    finally:
        remove(spark, staged)
    versions.expire(spark, path, keep)


def read_upserted(spark: SparkSession, path: str, number: int | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """The newest version behind ``path``, or that of a number, with all columns of all loads.

    ``start`` and ``end`` (both included) choose periods: rows of other times in
    them, and rows without time, may be among the result.
    """
    found = versions.version(spark, path, number)
    if found is None:
        raise ValueError(f"no table at {path}")
    chosen = None
    if start or end:
        lo, hi = (d and d.strftime("%Y%m%d") for d in (start, end))
        chosen = {p for p in found.periods if p == "none" or (not lo or p >= lo[: len(p)]) and (not hi or p <= hi[: len(p)])}
    return versions.read(spark, path, found, chosen)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def store_mart(df: DataFrame, path: str, time: str) -> None:
    """Write a mart partitioned by year and month of ``time``; readers prune by both.

    Replaces the months present in ``df`` and keeps all others.
    """
    parts = {"year": F.year(time), "month": F.month(time)}
    _replace_partitions(df.withColumns(parts), path, *parts)


def _replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions present in ``df`` and keep all others.

    The rebalance groups the rows by partition for few files, and splits one
    that is too large for one task.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*columns)
        .parquet(path)
    )


def append(df: DataFrame, path: str) -> None:
    """Add rows to a log or ledger."""
    df.write.mode("append").parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def export_snapshot(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Write each table to ``folder/<name>`` as Parquet with zstd."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, names: Sequence[str] = MARTS) -> dict[str, DataFrame]:
    """Read a snapshot and expose each table as a view of its name."""
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in names}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return tables


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def scan(
    df: DataFrame, site: str, start: date | datetime, end: date | datetime, key: str = "city", time: str = "time"
) -> DataFrame:
    """Rows of one site between two times (both included), in time order."""
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    return df.filter((F.col(key) == site) & F.col(time).between(lo, hi)).orderBy(time)


def latest_forecast(
    snapshots: DataFrame,
    columns: Sequence[str],
    past_days: int = 2,
    ahead_days: int = 4,
    as_of: datetime | None = None,
) -> DataFrame:
    """Hours of the newest snapshot per site, from two days back to four days ahead.

    ``snapshots`` has city, fetched_at, time and the columns; ``as_of`` leaves
    out snapshots fetched later. ``current_time`` is the snapshot's current
    hour; hours without any value are dropped.
    """
    if as_of is not None:
        snapshots = snapshots.filter(F.col("fetched_at") <= F.lit(as_of).cast("timestamp_ntz"))
    newest = snapshots.groupBy("city").agg(F.max("fetched_at").alias("fetched_at"))
    today = F.date_trunc("day", "fetched_at").cast("timestamp_ntz")
    rows = snapshots.join(newest, ["city", "fetched_at"], "left_semi")
    return (
        rows.filter(
            (F.col("time") >= F.timestamp_add("DAY", F.lit(-past_days), today))
            & (F.col("time") < F.timestamp_add("DAY", F.lit(ahead_days), today))
        )
        .dropna(how="all", subset=list(columns))
        .select(
            "city",
            "fetched_at",
            F.date_trunc("hour", "fetched_at").cast("timestamp_ntz").alias("current_time"),
            "time",
            *columns,
        )
    )
