"""Season and forecast alerts for one date and all sites at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.calendar import doy_to_date
from stationlake.model import hourly_columns
from stationlake.operators.reshape import unpivot
from stationlake.operators.runs import first_run
from stationlake.plans.climatology import seasons_with_doy, typical_seasons

ALERT_SCHEMA = (
    "kind string, city string, pollen_type string, days int, start date, earliest date, "
    "latest date, first_year int, last_year int, from_time timestamp_ntz, peak double"
)


def coming_alerts(seasons: DataFrame, as_of: date, lead: int = 14) -> DataFrame:
    """Seasons that typically start within 1 … ``lead`` days.

    Uses the calendar year of ``as_of`` only: a start in early January is not
    announced in December.
    """
    history = seasons_with_doy(seasons).groupBy("pollen_type", "city").agg(
        F.median("start_doy").alias("start_doy"),
        F.min("start_doy").alias("__first"),
        F.max("start_doy").alias("__last"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    start = doy_to_date("start_doy", as_of.year)
    days = F.datediff(start, F.lit(as_of))
    return history.select(
        F.lit("coming").alias("kind"),
        "city",
        "pollen_type",
        days.alias("days"),
        start.alias("start"),
        doy_to_date("__first", as_of.year).alias("earliest"),
        doy_to_date("__last", as_of.year).alias("latest"),
        "first_year",
        "last_year",
    ).filter(F.col("days").between(1, lead))


def in_typical_season(seasons: DataFrame, as_of: date) -> DataFrame:
    """Species and sites whose typical season contains the date."""
    return (
        typical_seasons(seasons)
        .select(
            "city",
            "pollen_type",
            doy_to_date("start_doy", as_of.year).alias("start"),
            doy_to_date("end_doy", as_of.year).alias("end"),
        )
        .filter(F.lit(as_of).between(F.col("start"), F.col("end")))
    )


def forecast_alerts(
    forecast: DataFrame,
    columns: Mapping[str, str] | None = None,
    level: float = 10.0,
    run: int = 3,
) -> DataFrame:
    """First hour of the first run at or above the level, and the peak of all hours to come.

    ``forecast`` holds one snapshot per site with the column ``current_time``;
    only rows from that hour on count, unknown values count as zero.
    """
    columns = {s.capitalize(): c for s, c in (columns or hourly_columns()).items()}
    future = forecast.filter(F.col("time") >= F.col("current_time"))
    long = unpivot(future, ["city", "time"], columns, "pollen_type", "value", keep_null=True)
    filled = long.withColumn("value", F.coalesce("value", F.lit(0.0)))
    keys = ["city", "pollen_type"]
    # A snapshot holds a few days of hours per series.
    starts = first_run(
        filled, keys, "time", F.col("value") >= level, run, "from_time", short=True
    )
    peaks = filled.groupBy(*keys).agg(F.max("value").alias("peak"))
    return starts.join(peaks, keys).select(
        F.lit("forecast").alias("kind"), "city", "pollen_type", "from_time", "peak"
    )


def check(
    seasons: DataFrame,
    as_of: date,
    forecast: DataFrame | None = None,
    today: date | None = None,
    **options,
) -> DataFrame:
    """All alerts of a date; the forecast, which needs ``today``, only counts when the date is the real today."""
    if forecast is not None and today is None:
        raise ValueError("a forecast is judged by the real today: give today")
    coming = coming_alerts(seasons, as_of)
    if forecast is None or as_of != today:
        return _as_alerts(coming)
    found = forecast_alerts(forecast, **options)
    return _as_alerts(coming).unionByName(_as_alerts(found))


def site_status(alerts: DataFrame, active: DataFrame, sites: DataFrame) -> DataFrame:
    """Traffic light per site: red in season or with a forecast alert, yellow with any alert."""
    marks = (
        alerts.select("city", (F.col("kind") == "forecast").alias("red"))
        .unionByName(active.select("city", F.lit(True).alias("red")))
        .unionByName(sites.select("city", F.lit(None).cast("boolean").alias("red")))
    )
    return (
        sites.select("city")
        .distinct()
        .join(marks.groupBy("city").agg(F.max("red").alias("red")), "city")
        .select(
            "city",
            F.when(F.col("red"), "red").when(~F.col("red"), "yellow").otherwise("green").alias("status"),
        )
    )


def active_species(alerts: DataFrame, active: DataFrame) -> DataFrame:
    """Species in season or alerted, per site."""
    keys = ["city", "pollen_type"]
    return alerts.select(*keys).unionByName(active.select(*keys)).distinct()


def next_season(seasons: DataFrame, as_of: date) -> DataFrame:
    """Per site the earliest typical start after the date, this year or next; ties by name."""
    this_year = doy_to_date("start_doy", as_of.year)
    next_year = doy_to_date("start_doy", as_of.year + 1)
    start = F.when(this_year > F.lit(as_of), this_year).otherwise(next_year)
    return (
        typical_seasons(seasons)
        .groupBy("city")
        .agg(F.min(F.struct(start.alias("start"), F.col("pollen_type"))).alias("__next"))
        .select("city", "__next.pollen_type", "__next.start")
    )


def next_season_doy(seasons: DataFrame, day: date) -> DataFrame:
    """Variant on a 365-day circle: the next start as a day of year."""
    doy = day.timetuple().tm_yday
    start = F.col("start_doy")
    ahead = F.when(start > doy, start).otherwise(start + 365)
    return (
        typical_seasons(seasons)
        .groupBy("city")
        .agg(F.min(F.struct(ahead.alias("ahead"), F.col("pollen_type"))).alias("__next"))
        .select(
            "city",
            "__next.pollen_type",
            F.when(F.col("__next.ahead") % 365 == 0, F.lit(365.0))
            .otherwise(F.col("__next.ahead") % 365)
            .alias("start_doy"),
        )
    )


def alert_key(channel: Column | str) -> Column:
    """Key under which an alert is remembered: once per season, or once per forecast day."""
    ch = F.lit(channel) if isinstance(channel, str) else channel
    moment = F.when(F.col("kind") == "coming", F.year("start").cast("string")).otherwise(
        F.date_format("from_time", "yyyy-MM-dd")
    )
    return F.concat_ws("|", ch, "city", "pollen_type", "kind", moment)


def with_keys(alerts: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per alert and channel, with its key."""
    channel = F.explode(F.array(*[F.lit(c) for c in channels]))
    return _as_alerts(alerts).withColumn("channel", channel).withColumn(
        "alert_key", alert_key(F.col("channel"))
    )


def unsent(keyed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Alerts whose key is not in the ledger, each key once."""
    fresh = keyed.join(ledger.select("alert_key"), "alert_key", "left_anti")
    return fresh.dropDuplicates(["alert_key"])


def _as_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts of any kind with the columns of all kinds."""
    fields = [f.strip().split(" ") for f in ALERT_SCHEMA.split(",")]
    return alerts.select(
        *[
            F.col(n).cast(t).alias(n) if n in alerts.columns else F.lit(None).cast(t).alias(n)
            for n, t in fields
        ]
    )
