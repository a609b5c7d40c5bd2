"""Stored marts that a load brings up to date: only the days, weeks and years it touches are computed again.

A load names the (site, local day) pairs it holds rows of. These are carried
from mart to mart: to the hours and the day itself, to its ISO week, to the
season of its calendar year; and, by the year in UTC, to the counts of missing
values. All other rows stay as they are. The result equals marts built anew
from all raw rows.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.calendar import iso_week, iso_year, local_time
from stationlake.model import SOURCES, SPECIES, ZONE, raw_schema
from stationlake.plans import marts
from stationlake.session import work_path
from stationlake.sources import tables, versions

NO_PERIOD = "none"


def refresh(
    spark: SparkSession,
    folder: str,
    air: DataFrame | None = None,
    weather: DataFrame | None = None,
    zone: str = ZONE,
    species: Sequence[str] = SPECIES,
    min_hours: int = 23,
    keep: int = 2,
) -> None:
    """Put a load of raw rows into the raw tables below ``folder`` and bring the five marts up to date.

    A row replaces the one of its site and time. Hours and days are kept in
    months, weeks in ISO years, seasons and missing values in years; a load
    reads and writes only the periods it touches, and in them computes only
    the touched keys. Rows without site or time belong to a key of their own.

    Each table changes in one step. A load that fails midway is repeated with
    the same rows; of two loads at a time one may be told to repeat
    (``versions.VersionTaken``), as every mart is opened before its inputs are.
    ``zone``, ``species`` and ``min_hours`` must stay the same over all loads.
    """
    batches = {}
    for source, batch in (("air_quality", air), ("weather", weather)):
        if batch is None:
            continue
        staged = work_path(spark, f"load-{source}")
        batch.write.parquet(staged)
        batches[source] = spark.read.schema(batch.schema).parquet(staged)
        tables.upsert(spark, f"{folder}/raw/{source}", batches[source], keep=keep)
    if not batches:
        return
    touched = work_path(spark, "load-days")
    day = F.to_date(local_time("time", zone)).alias("date_local")
    reduce(DataFrame.union, [b.select("city", day) for b in batches.values()]).distinct().write.parquet(touched)
    days = spark.read.schema("city string, date_local date").parquet(touched)
    # One entry for each day of the calendar.
    dates = [r["date_local"] for r in days.select("date_local").distinct().collect()]

    _hourly(spark, folder, days, dates, zone, species, keep)
    _daily(spark, folder, days, dates, species, min_hours, keep)
    _weekly(spark, folder, days, dates, species, keep)
    _seasons(spark, folder, days, dates, species, keep)
    for source, batch in batches.items():
        _missing(spark, folder, source, batch, keep)


def read_mart(spark: SparkSession, folder: str, name: str, number: int | None = None) -> DataFrame:
    """A mart as the newest load left it, or as of a version's number."""
    return tables.read_upserted(spark, f"{folder}/{name}", number)


def _hourly(spark, folder, days, dates, zone, species, keep) -> None:
    path = f"{folder}/hourly"
    before = versions.version(spark, path)
    # A local day lies within three days in UTC.
    months = _months(d + timedelta(n) if d else None for d in dates for n in (-1, 0, 1))

    def staged(source: str, stage) -> DataFrame:
        rows = stage(_raw(spark, folder, source, months))
        local_day = rows.withColumn("date_local", F.to_date("time_local"))
        return _matching(local_day, days, ["city", "date_local"], "left_semi").drop("date_local")

    air = staged("air_quality", lambda raw: marts.stage_air_quality(raw, zone, species))
    weather = staged("weather", lambda raw: marts.stage_weather(raw, zone))
    fresh = marts.hourly(air, weather)
    _replace(spark, path, before, fresh, days, ["city", "date_local"], _month("date_local"), _months(dates), keep)


def _daily(spark, folder, days, dates, species, min_hours, keep) -> None:
    path, keys = f"{folder}/daily", ["city", "date_local"]
    before = versions.version(spark, path)
    hours = _stored(spark, f"{folder}/hourly", _months(dates))
    fresh = marts.daily(_matching(hours, days, keys, "left_semi"), min_hours, species)
    _replace(spark, path, before, fresh, days, keys, _month("date_local"), _months(dates), keep)


def _weekly(spark, folder, days, dates, species, keep) -> None:
    path, keys = f"{folder}/weekly", ["city", "iso_year", "iso_week"]
    before = versions.version(spark, path)
    week = {"iso_year": iso_year("date_local"), "iso_week": iso_week("date_local")}
    weeks = days.withColumns(week).select(*keys).distinct()
    months = _months(d + timedelta(n - d.weekday()) if d else None for d in dates for n in (0, 6))
    rows = _stored(spark, f"{folder}/daily", months).withColumns(week)
    fresh = marts.weekly(_matching(rows, weeks, keys, "left_semi").drop(*week), species)
    years = {f"{d.isocalendar().year:04d}" if d else NO_PERIOD for d in dates}
    _replace(spark, path, before, fresh, weeks, keys, _label("iso_year"), years, keep)


def _seasons(spark, folder, days, dates, species, keep) -> None:
    path, keys = f"{folder}/seasons", ["city", "year"]
    before = versions.version(spark, path)
    years = days.select("city", F.year("date_local").alias("year")).distinct()
    labels = {f"{d.year:04d}" if d else NO_PERIOD for d in dates}
    rows = _stored(spark, f"{folder}/daily", lambda p: p == NO_PERIOD and p in labels or p[:4] in labels)
    rows = rows.withColumn("year", F.year("date_local"))
    columns = {s: f"{s}_pollen_avg" for s in species}
    fresh = marts.seasons(_matching(rows, years, keys, "left_semi").drop("year"), columns)
    _replace(spark, path, before, fresh, years, keys, _label("year"), labels, keep)


def _missing(spark, folder, source, batch, keep) -> None:
    """Counts per site and year of one source; of all years where the raw table has columns not counted yet."""
    path, keys = f"{folder}/missing_values", ["source", "city", "year"]
    before = versions.version(spark, path)
    raw_path = f"{folder}/raw/{source}"
    years = batch.select(F.lit(source).alias("source"), "city", F.year("time").alias("year")).distinct()
    raw_table = versions.version(spark, raw_path)
    variables = {c for c in raw_table.columns.names if c not in ("city", "time", "loaded_at")}
    all_years = before is not None and variables != _counted(spark, path, before, source)
    if all_years:
        labels = {p if p == NO_PERIOD else p[:4] for p in raw_table.periods}
    else:
        labels = {NO_PERIOD if r["year"] is None else f"{r['year']:04d}" for r in years.select("year").distinct().collect()}
    raw = _stored(spark, raw_path, lambda p: (p if p == NO_PERIOD else p[:4]) in labels)
    if all_years:
        stale = spark.createDataFrame([(source,)], "source string")
        fresh = marts.missing_values({source: raw})
        _replace(spark, path, before, fresh, stale, ["source"], _label("year"), labels, keep)
        return
    of_years = raw.withColumns({"source": F.lit(source), "year": F.year("time")})
    rows = _matching(of_years, years, keys, "left_semi").drop("source", "year")
    _replace(spark, path, before, marts.missing_values({source: rows}), years, keys, _label("year"), labels, keep)


def _counted(spark: SparkSession, path: str, at: versions.Version, source: str) -> set[str]:
    """Variables of a source in the mart: a number bounded by the columns."""
    rows = versions.read(spark, path, at).filter(F.col("source") == source)
    return {r["variable"] for r in rows.select("variable").distinct().collect()}


def _replace(
    spark: SparkSession,
    path: str,
    before: versions.Version | None,
    fresh: DataFrame,
    touched: DataFrame,
    keys: Sequence[str],
    period: Column,
    periods: Collection[str],
    keep: int,
) -> None:
    """Rows of the touched keys give way to ``fresh``; the others of these periods are carried over."""
    columns = versions.widened(spark, before.columns if before else fresh.schema, fresh.schema)
    rows = fresh
    if before:
        stored = versions.read(spark, path, before, set(periods))
        rows = _matching(stored, touched, keys, "left_anti").unionByName(fresh, allowMissingColumns=True)
    versions.replace(spark, path, before, rows.withColumn("__period", period), columns, "__period", gone=periods)
    versions.expire(spark, path, keep)


def _matching(rows: DataFrame, touched: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose keys are among (or, by an anti join, not among) the touched ones; null is a key like others."""
    other = touched.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return rows.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


def _raw(spark: SparkSession, folder: str, source: str, months: Collection[str]) -> DataFrame:
    path = f"{folder}/raw/{source}"
    if versions.version(spark, path) is None:
        return spark.createDataFrame([], raw_schema(SOURCES[source]))
    return _stored(spark, path, months)


def _stored(spark: SparkSession, path: str, periods) -> DataFrame:
    """Rows of some periods, given as a collection or a condition on their names."""
    found = versions.version(spark, path)
    chosen = {p for p in found.periods if (periods(p) if callable(periods) else p in periods)}
    return versions.read(spark, path, found, chosen)


def _months(dates: Iterable[date | None]) -> set[str]:
    return {d.strftime("%Y%m") if d else NO_PERIOD for d in dates}


def _month(day: str) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMM"), F.lit(NO_PERIOD))


def _label(year: str) -> Column:
    return F.coalesce(F.lpad(F.col(year).cast("string"), 4, "0"), F.lit(NO_PERIOD))
