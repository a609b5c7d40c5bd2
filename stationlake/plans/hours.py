"""Hourly values around a date: history, forecast or the typical course."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import shift_years
from stationlake.model import HIGH, hourly_columns

DAYS_BEFORE, DAYS_AFTER = 2, 4


def hour_window(
    hours: DataFrame,
    start: date,
    end: date,
    sites: DataFrame | None = None,
    columns: Sequence[str] | None = None,
    site: str | None = None,
) -> DataFrame:
    """Local hours from ``start`` up to but not including ``end``.

    A stored table is partitioned by the UTC ``year``, which is then filtered
    too. Sites outside the site dimension are not returned.
    """
    columns = list(columns or hourly_columns().values())
    rows = hours.filter(
        (F.col("time_local") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("time_local") < F.lit(end).cast("timestamp_ntz"))
    )
    if "year" in hours.columns:
        near = (start - timedelta(days=1)).year, (end + timedelta(days=1)).year
        rows = rows.filter(F.col("year").between(*near))
    if site is not None:
        rows = rows.filter(F.col("city") == site)
    if sites is not None:
        rows = rows.join(sites.select("city"), "city", "left_semi")
    return rows.select("city", F.col("time_local").alias("time"), *columns)


def typical_window(
    hours: DataFrame,
    days: DataFrame,
    start: date,
    end: date,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Mean course of the same calendar dates in every year that covers them all.

    Each covered year's hours are moved onto the requested dates and averaged;
    ``years`` lists the years a value comes from. The covered dates are a table
    of at most (end - start) rows per calendar year, and the hours are joined on
    their date: one scan for all years.
    """
    columns = list(columns or hourly_columns().values())
    span = days.agg(F.min("date_local").alias("first"), F.max("date_local").alias("last"))
    year = F.explode(F.sequence(F.year("first"), F.year("last")))
    shift = F.col("year") - F.lit(start.year)
    windows = (
        span.select("first", "last", year.alias("year"))
        .withColumns(
            {"s": shift_years(F.lit(start), shift), "e": shift_years(F.lit(end), shift)}
        )
        .filter((F.col("s") >= F.col("first")) & (F.col("e") <= F.date_add("last", 1)))
    )
    dates = windows.select(
        "year", "s", F.explode(F.sequence("s", F.date_sub("e", 1))).alias("date_local")
    )
    moved = F.timestamp_add(
        "DAY", F.datediff(F.lit(start), F.col("s")), F.col("time_local")
    )
    # The calendar months of the window are known now: a stored table reads only these,
    # by the month in UTC, which is that of the local date or of a day beside it.
    near = [start + timedelta(days=i) for i in range(-1, (end - start).days + 2)]
    months = sorted({d.month for d in near})
    rows = hours.filter(F.month("date_local").isin(months))
    if "month" in hours.columns:
        rows = rows.filter(F.col("month").isin(months))
    return (
        rows.select("city", "date_local", "time_local", *columns)
        .join(dates, "date_local")
        .groupBy("city", moved.alias("time"))
        .agg(
            *[F.avg(c).alias(c) for c in columns],
            F.sort_array(F.collect_set("year")).alias("years"),
        )
    )


def best_source(
    hours: DataFrame,
    days: DataFrame,
    forecast: DataFrame,
    day: date,
    today: date,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Hourly values around ``day`` from the best source, per site, labelled by ``kind``.

    - ``live``: the day is today; the site's latest forecast snapshot
    - ``history``: the day is not after the last stored day
    - ``forecast`` / ``recent``: a day after / before today inside the snapshot
    - ``typical``: any other day; mean of the same dates in the covered years

    Stored and typical values cover two days before to four days after the day.
    """
    columns = list(columns or hourly_columns().values())
    start, end = day - timedelta(days=DAYS_BEFORE), day + timedelta(days=DAYS_AFTER + 1)
    snapshot = forecast.select("city", "time", *columns)
    if day == today:
        return snapshot.withColumn("kind", F.lit("live"))

    stored = F.lit(day) <= days.agg(F.max("date_local")).scalar()
    history = hour_window(hours, start, end, columns=columns).filter(stored)
    sites_with_day = snapshot.filter(F.to_date("time") == F.lit(day)).select("city").distinct()
    ahead = snapshot.join(sites_with_day, "city", "left_semi").filter(~stored)
    typical = typical_window(hours, days, start, end, columns).filter(~stored)
    typical = typical.join(sites_with_day, "city", "left_anti")
    near = "forecast" if day > today else "recent"
    return (
        history.withColumn("kind", F.lit("history"))
        .unionByName(ahead.withColumn("kind", F.lit(near)))
        .unionByName(typical.select("city", "time", *columns, F.lit("typical").alias("kind")))
    )


def day_summary(
    hours: DataFrame,
    day: date,
    columns: Mapping[str, str] | None = None,
    levels: Mapping[str, float] = HIGH,
    time: str = "time",
    trace_below: float = 1.0,
) -> DataFrame:
    """Strongest species of a day per site, its peak and peak hour, and a class.

    Classes: ``none`` (nothing above zero), ``trace`` (below 1), ``high`` (above
    the species' level), else ``present``. Equal peaks: first species in order;
    equal hours: the earlier one. The peak hour is given from ``present`` on.
    """
    columns = columns or hourly_columns()
    of_day = hours.filter(F.to_date(time) == F.lit(day))
    peaks = of_day.groupBy("city").agg(
        *[
            F.min(
                F.when(
                    F.col(c).isNotNull(),
                    F.struct((-F.col(c)).alias("neg"), F.col(time).alias("at")),
                )
            ).alias(f"__{s}")
            for s, c in columns.items()
        ]
    )
    ranked = [
        F.when(
            F.col(f"__{s}").isNotNull(),
            F.struct(
                F.col(f"__{s}.neg").alias("neg"),
                F.lit(i).alias("ord"),
                F.lit(s.capitalize()).alias("species"),
                F.col(f"__{s}.at").alias("at"),
                F.lit(float(levels[s])).alias("level"),
            ),
        )
        for i, s in enumerate(columns)
    ]
    top = F.array_min(F.array(*ranked))
    peak = -F.col("__top.neg")
    kind = (
        F.when(~F.coalesce(peak > 0, F.lit(False)), "none")
        .when(peak < trace_below, "trace")
        .when(peak > F.col("__top.level"), "high")
        .otherwise("present")
    )
    shown = kind.isin("high", "present")
    return peaks.withColumn("__top", top).select(
        "city",
        F.when(kind != "none", F.col("__top.species")).alias("pollen_type"),
        F.when(kind != "none", peak).alias("peak"),
        F.when(shown, F.hour("__top.at")).alias("peak_hour"),
        kind.alias("level"),
    )
