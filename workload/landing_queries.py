"""Landed payloads, incremental load, stored tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from stationlake.functions.calendar import days_behind, publication_time
from stationlake.model import ZONE
from stationlake.plans import climatology as cl
from stationlake.plans import marts
from stationlake.session import work_path
from stationlake.sources import landing as la
from stationlake.sources import tables as tb
from workload import sql
from workload.climatology_queries import POLLEN
from workload.fixtures import (
    event_hours,
    landed_payloads,
    obs_daily,
    raw_air,
    regions_of,
    stored,
    table,
)
from workload.registry import register

RUN_AT = datetime(2024, 2, 1, 4, 30)


@register(
    "landed_json_rows",
    sql.query(
        [sql.EVENT_HOURS],
        f"SELECT city, time, {', '.join(POLLEN)} FROM event_hours WHERE coalesce({', '.join(POLLEN)}) IS NOT NULL",
    ),
)
def _(spark, sf):
    return la.payload_rows(landed_payloads(spark, sf), POLLEN)


@register(
    "load_log",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT TIMESTAMP '2024-02-01 04:30:00' AS run_at, 'air_quality' AS source, city,
             min(time)::DATE AS start_date, DATE '2024-01-31' AS end_date,
             (count(*) FILTER (WHERE day NOT IN (5, 6, 7)))::INTEGER AS rows_loaded,
             CASE WHEN count(DISTINCT day) FILTER (WHERE day IN (5, 6, 7)) > 0 THEN 'error' ELSE 'ok' END AS status,
             CASE WHEN count(DISTINCT day) FILTER (WHERE day IN (5, 6, 7)) > 0 THEN concat_ws(', ',
               CASE WHEN bool_or(day = 5) THEN '1 unreadable' END,
               CASE WHEN bool_or(day = 7) THEN '1 uneven arrays' END,
               CASE WHEN bool_or(day = 6) THEN '1 bad time' END) || ' payload(s)' END AS error
           FROM (SELECT *, CASE WHEN year(time) = 2024 AND month(time) = 1 THEN day(time) ELSE 0 END AS day FROM event_hours)
           GROUP BY city""",
    ),
)
def load_log_of(spark, sf):
    """Payloads of three days are damaged, each in its way: the others must still be loaded and logged."""
    payloads = la.parsed(damaged_payloads(spark, sf), POLLEN)
    rows = la.payload_rows(payloads, POLLEN)
    return la.load_log(payloads, rows, "air_quality", date(2024, 1, 31), RUN_AT, POLLEN)


def damaged_payloads(spark, sf):
    damage = (
        F.when(F.col("start") == F.lit(date(2024, 1, 5)), F.expr("substring(body, 2)"))
        .when(F.col("start") == F.lit(date(2024, 1, 6)), F.regexp_replace("body", r"(\d)T(\d)", "$1 at $2"))
        .when(F.col("start") == F.lit(date(2024, 1, 7)), F.regexp_replace("body", r'"time":\s*\["[^"]*",?\s*', '"time":['))
    )
    return landed_payloads(spark, sf).withColumn("body", F.coalesce(damage, F.col("body")))


LOADS = (datetime(2024, 1, 11, 4, 30), RUN_AT)


def loads_from_files(spark, sf):
    """Payload files of the first ten days are landed and loaded, then the others, by a second load that sees both."""
    folder, record = work_path(spark, "landed"), work_path(spark, "seen")
    files = damaged_payloads(spark, sf).select("city", F.col("start").alias("day"), "body").repartition("city", "day")
    early = F.col("day") < F.lit(date(2024, 1, 11))
    files.filter(early).write.partitionBy("city", "day").text(folder)
    first = la.read_payloads(spark, folder)
    first.select("file", "modified").write.parquet(record)
    files.filter(~early).write.mode("append").partitionBy("city", "day").text(folder)
    second = la.read_payloads(spark, folder, spark.read.parquet(record))
    return [la.loaded_files(p, POLLEN, at) for p, at in zip((first, second), LOADS)]


@register(
    "load_landed_files",
    sql.query(
        [sql.EVENT_HOURS],
        f"""SELECT city, time, {', '.join(POLLEN)},
              CASE WHEN time < TIMESTAMP '2024-01-11' THEN TIMESTAMP '{LOADS[0]}' ELSE TIMESTAMP '{LOADS[1]}' END AS loaded_at
            FROM event_hours
            WHERE coalesce({', '.join(POLLEN)}) IS NOT NULL AND time::DATE NOT IN (DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-07')""",
    ),
)
def _(spark, sf):
    (early, _), (late, _) = loads_from_files(spark, sf)
    return early.unionByName(late)


@register(
    "rejected_files",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT city, CASE day(time) WHEN 5 THEN 'unreadable' WHEN 6 THEN 'bad time' ELSE 'uneven arrays' END AS problem, count(DISTINCT time::DATE) AS n_files
           FROM event_hours WHERE time::DATE IN (DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-07') GROUP BY ALL""",
    ),
)
def _(spark, sf):
    (_, early), (_, late) = loads_from_files(spark, sf)
    return early.unionByName(late).groupBy("city", "problem").agg(F.count("file").alias("n_files"))


@register(
    "last_run_local",
    """SELECT event_type AS source, timezone('Europe/Stockholm', timezone('UTC', max(ts))) AS last_run_local
       FROM events GROUP BY event_type""",
)
def _(spark, sf):
    """Every event stands for a run of its type's load."""
    runs = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("run_at"))
    return la.last_run(runs, ZONE)


@register(
    "publication_time",
    """SELECT event_type, strftime(timezone('Europe/Stockholm',
         (TIMESTAMP '1970-01-01' + to_seconds(round_even(date_diff('second', TIMESTAMP '1970-01-01', max(ts)) / 1800.0::DOUBLE, 0)::BIGINT * 1800))
           AT TIME ZONE 'UTC'), '%H:%M') AS published
       FROM events GROUP BY event_type""",
)
def _(spark, sf):
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.max("ts"))
    newest = table(spark, sf, "events").groupBy("event_type").agg(epoch.alias("epoch"))
    return newest.select("event_type", publication_time("epoch").alias("published"))


@register(
    "load_watermark",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR],
        """SELECT p.city, coalesce(max(time)::DATE, DATE '1995-01-01') AS start
           FROM (SELECT n_name AS city FROM nation UNION ALL SELECT r_name FROM region) p
           LEFT JOIN raw_air a ON a.city = p.city GROUP BY p.city""",
    ),
)
def _(spark, sf):
    places = regions_of(spark, sf)
    known = places.select("city").unionByName(places.select(F.col("region").alias("city")).distinct())
    return la.next_start(raw_air(spark, sf), known, date(1995, 1, 1))


@register(
    "year_chunks",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily()],
        """SELECT city, greatest(a, make_date(y::INTEGER, 1, 1)) AS chunk_start, least(b, make_date(y::INTEGER, 12, 31)) AS chunk_end
           FROM (SELECT city, a, b, unnest(generate_series(year(a), year(b))) AS y FROM
                  (SELECT city, min(date_local) AS a, max(date_local) AS b FROM obs_daily GROUP BY city))""",
    ),
)
def _(spark, sf):
    spans = obs_daily(spark, sf).groupBy("city").agg(
        F.min("date_local").alias("start"), F.max("date_local").alias("end")
    )
    return la.year_chunks(spans)


def corrected(spark, sf):
    """A later load of the last two years with corrected values and one more column."""
    newer = raw_air(spark, sf).filter(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return newer.withColumns(
        {
            "pm10": F.col("pm10") + 1,
            "loaded_at": F.lit("2002-02-01 00:00:00").cast("timestamp_ntz"),
            "checked": F.lit(True),
        }
    )


UPSERTED = """
SELECT city, time, alder_pollen, birch_pollen, grass_pollen, mugwort_pollen, pm2_5,
  CASE WHEN time >= '2000-01-01' THEN pm10 + 1 ELSE pm10 END AS pm10, ozone, nitrogen_dioxide,
  CASE WHEN time >= '2000-01-01' THEN TIMESTAMP '2002-02-01' ELSE loaded_at END AS loaded_at,
  CASE WHEN time >= '2000-01-01' THEN true END AS checked
FROM raw_air"""


@register("upsert_latest", sql.query([sql.SITE_LINES, sql.RAW_AIR], UPSERTED))
def _(spark, sf):
    return tb.merged(raw_air(spark, sf), corrected(spark, sf), ["city", "time"])


@register("upsert_table", sql.query([sql.SITE_LINES, sql.RAW_AIR], UPSERTED))
def _(spark, sf):
    """The same through a stored table: load, correct with one more column, load a part again without it."""
    path = work_path(spark, "raw_air")
    tb.upsert(spark, path, raw_air(spark, sf))
    tb.upsert(spark, path, corrected(spark, sf))
    tb.upsert(spark, path, raw_air(spark, sf).filter(F.col("time") < F.lit("1999-01-01").cast("timestamp_ntz")))
    return tb.read_upserted(spark, path)


def _since(df, day):
    return df.filter(F.col("time") >= F.lit(day).cast("timestamp_ntz"))


@register(
    "upsert_types",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR],
        """SELECT city, time, CASE WHEN time >= '2001-01-01' THEN pm10 WHEN time >= '2000-01-01' THEN floor(pm10) + 3000000000
             ELSE floor(pm10) END AS amount FROM raw_air""",
    ),
)
def _(spark, sf):
    """A column that is int in the first load, bigint in the second and double in the third."""
    path, air = work_path(spark, "types"), raw_air(spark, sf)
    amount = F.floor("pm10").cast("int")
    tb.upsert(spark, path, air.select("city", "time", "loaded_at", amount.alias("amount")))
    wide = (amount.cast("long") + F.lit(3_000_000_000)).alias("amount")
    tb.upsert(spark, path, _since(air, "2000-01-01").select("city", "time", "loaded_at", wide))
    tb.upsert(spark, path, _since(air, "2001-01-01").select("city", "time", "loaded_at", F.col("pm10").alias("amount")))
    return tb.read_upserted(spark, path).select("city", "time", "amount")


@register(
    "upsert_versions",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR],
        """SELECT city, time, pm10 AS before, CASE WHEN time >= '2000-01-01' THEN pm10 + 1 ELSE pm10 END AS after FROM raw_air""",
    ),
)
def _(spark, sf):
    """Both versions of a table side by side: the one before the correction stays as it was."""
    path = work_path(spark, "versions")
    tb.upsert(spark, path, raw_air(spark, sf))
    tb.upsert(spark, path, corrected(spark, sf))
    before, after = (tb.read_upserted(spark, path, n).select("city", "time", "pm10") for n in (1, 2))
    return before.withColumnRenamed("pm10", "before").join(after.withColumnRenamed("pm10", "after"), ["city", "time"])


@register(
    "filter_between",
    sql.query(
        [sql.SITE_LINES, sql.RAW_AIR],
        """SELECT * FROM raw_air WHERE city = 'ASIA' AND time BETWEEN '1999-05-01' AND '1999-05-31'""",
    ),
)
def _(spark, sf):
    return tb.scan(raw_air(spark, sf), "ASIA", date(1999, 5, 1), date(1999, 5, 31))


@register(
    "snapshot_roundtrip",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily(), sql.seasons()],
        """SELECT 'daily' AS name, count(*) AS n_rows, min(date_local) AS first_day FROM obs_daily
           UNION ALL SELECT 'seasons', count(*), min(season_start) FROM seasons""",
    ),
)
def _(spark, sf):
    folder = work_path(spark, "snapshot")
    days = stored(obs_daily(spark, sf), "days")
    tb.export_snapshot({"daily": days, "seasons": marts.seasons(days)}, folder)
    tb.read_snapshot(spark, folder, ["daily", "seasons"])
    return spark.sql(
        """SELECT 'daily' AS name, count(*) AS n_rows, min(date_local) AS first_day FROM daily
           UNION ALL SELECT 'seasons', count(*), min(season_start) FROM seasons"""
    )


@register(
    "days_behind",
    sql.query(
        [sql.SITE_LINES, sql.obs_daily("n_name")],
        """SELECT city, greatest(date_diff('day', max(date_local), DATE '2001-11-05'), 0) AS days_behind
           FROM obs_daily GROUP BY city""",
        ints=["days_behind"],
    ),
)
def _(spark, sf):
    last = obs_daily(spark, sf, "n_name").groupBy("city").agg(F.max("date_local").alias("last_day"))
    today = F.lit(date(2001, 11, 6))
    return last.select("city", days_behind("last_day", today).alias("days_behind"))


@register(
    "last_update",
    sql.query(
        [sql.EVENT_HOURS],
        """SELECT count(DISTINCT city) AS n_cities, min(time)::DATE AS first_day, max(time)::DATE AS last_day
           FROM event_hours""",
    ),
)
def _(spark, sf):
    days = event_hours(spark, sf).select("city", F.to_date("time").alias("date_local"))
    return cl.data_coverage(days)
