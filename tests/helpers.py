"""Small tables for the unit tests."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from stationlake.model import SPECIES


def rows(df, *order):
    """Rows as plain tuples, sorted by the given columns."""
    listed = df.orderBy(*order).collect() if order else df.collect()
    return [tuple(r) for r in listed]


def daily_table(spark, frame: pd.DataFrame, **defaults):
    """Daily table with all columns; those not given are 0 or the given default."""
    columns = {
        **{f"{s}_pollen_avg": 0.0 for s in SPECIES},
        **{f"{s}_pollen_max": 0.0 for s in SPECIES},
        "pm2_5_avg": 0.0, "ozone_avg": 0.0, "temperature_avg_c": 10.0, "temperature_max_c": 15.0,
        "precipitation_mm": 0.0, "wind_speed_avg_kmh": 5.0,
        **defaults,
    }
    full = frame.assign(**{c: v for c, v in columns.items() if c not in frame})
    schema = "city string, date_local date, " + ", ".join(f"{c} double" for c in columns)
    ordered = full[["city", "date_local", *columns]].astype({c: float for c in columns})
    listed = [
        tuple(None if isinstance(v, float) and pd.isna(v) else v for v in r)
        for r in ordered.itertuples(index=False)
    ]
    return spark.createDataFrame(listed, schema)


def days(start: str, n: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def hours(start: str, n: int) -> list[dt.datetime]:
    first = dt.datetime.fromisoformat(start)
    return [first + dt.timedelta(hours=i) for i in range(n)]


def seasons_table(spark, listed):
    """(city, species, year, start, peak, end[, total]) rows as a seasons table."""
    full = [
        (c, p, y, s, k, e, s.isocalendar()[1], k.isocalendar()[1], e.isocalendar()[1],
         (e - s).days + 1, 1.0, float(rest[0]) if rest else 100.0)
        for c, p, y, s, k, e, *rest in listed
    ]
    return spark.createDataFrame(
        full,
        "city string, pollen_type string, year int, season_start date, peak_date date, "
        "season_end date, start_week int, peak_week int, end_week int, season_days int, "
        "peak_pollen double, year_total double",
    )
