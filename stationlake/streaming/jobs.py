"""Structured Streaming forms of the load, the daily table and the alerts."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationlake.operators.neighbours import with_neighbours
from stationlake.plans.alerts import unsent
from stationlake.session import work_path
from stationlake.sources import versions
from stationlake.sources.tables import remove, table_exists, upsert


def upsert_batches(
    path: str, keys: Sequence[str] = ("city", "time"), version: Sequence[str] = ("loaded_at",), by: str = "month"
) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: keyed replace, so a repeated batch changes nothing."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        upsert(batch.sparkSession, path, batch, keys, version=version, by=by)

    return write


def daily_windows(
    stream: DataFrame,
    time: str,
    measures: Mapping[str, str],
    late: str = "2 days",
    min_rows: int = 1,
    site: str = "city",
) -> DataFrame:
    """Daily mean, maximum and number of rows per site over event-time windows of a day.

    Rows up to ``late`` behind the newest are accepted; a day is emitted once it
    is closed. Event time needs a zoned type, so the session runs in UTC.
    """
    stats = []
    for name, column in measures.items():
        stats += [F.avg(column).alias(f"{name}_avg"), F.max(column).alias(f"{name}_max")]
    return (
        stream.withColumn("__time", F.col(time).cast("timestamp"))
        .withWatermark("__time", late)
        .groupBy(F.window("__time", "1 day").alias("__day"), site)
        .agg(*stats, F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= min_rows)
        .select(
            site,
            F.to_date("__day.start").alias("day"),
            *[c for name in measures for c in (f"{name}_avg", f"{name}_max")],
            "n_rows",
        )
    )


def persistence_alerts(
    path: str,
    checkpoint: str,
    level: float,
    length: int = 3,
    late: str = "1 day",
    keys: Sequence[str] = ("city", "pollen_type"),
) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: one row per run of ``length`` rows in a row at or above the level, per series.

    Batches have the keys, ``time`` and ``value``. A row is judged once the
    newest time seen is ``late`` ahead of it, in order of time, so the result
    does not depend on how rows fall into batches. Until then it waits in the
    state, together with the last ``length`` rows judged of each series. Rows
    that come later than that are not lost: they are written to ``late``.

    ``<path>/<run>/alerts``, ``late`` and ``state`` have a folder per batch; a
    run is one checkpoint, so a repeated batch overwrites its own output only.
    """
    names = list(keys)
    state_schema = ", ".join(f"`{k}` string" for k in names) + ", time timestamp_ntz, value double, judged boolean"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = f"{path}/{checkpoint_id(spark, checkpoint)}"
        rows = batch.select(
            *[F.col(k).cast("string").alias(k) for k in names], F.col("time").cast("timestamp_ntz").alias("time"), F.col("value").cast("double").alias("value")
        ).filter(F.col("time").isNotNull())
        staged = f"{base}/staged/batch={batch_id}"
        rows.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(state_schema.replace(", judged boolean", "")).parquet(staged)
        before = f"{base}/state/batch={batch_id - 1}"
        state = spark.read.schema(state_schema).parquet(before) if table_exists(spark, before) else spark.createDataFrame([], state_schema)
        allowed = F.expr(f"INTERVAL {late}")
        seen, newest = state.agg(F.max("time") - allowed).first()[0], rows.agg(F.max("time") - allowed).first()[0]
        bound = max((t for t in (seen, newest) if t is not None), default=None)
        on_time = F.lit(True) if seen is None else F.col("time") > F.lit(seen)
        rows.filter(~on_time).write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
        waiting = state.unionByName(rows.filter(on_time).withColumn("judged", F.lit(False)))
        ready = F.lit(False) if bound is None else F.col("time") <= F.lit(bound)
        flagged = waiting.filter(ready).withColumn("__hit", F.coalesce(F.col("value") >= level, F.lit(False)))
        series = with_neighbours(flagged, names, "time", ["time", "__hit"], before=length, bucket=F.to_date("time"))
        full = F.col("__hit") & (F.size("prev") >= length - 1)
        if length > 1:
            hits = F.slice("prev", F.greatest(F.size("prev") - (length - 2), F.lit(1)), length - 1)
            full = full & F.forall(hits, lambda r: r["__hit"])
        first = (F.size("prev") < length) | ~F.get("prev", F.lit(0))["__hit"]
        start = F.get("prev", F.size("prev") - (length - 1))["time"] if length > 1 else F.col("time")
        found = series.filter(~F.col("judged") & full & first).select(*names, start.alias("run_start"), F.col("time").alias("alert_time"))
        found.write.mode("overwrite").parquet(f"{base}/alerts/batch={batch_id}")
        # At most ``length`` judged rows of a series stay.
        last = Window.partitionBy(*names).orderBy(F.desc("time"))
        tail = waiting.filter(ready).withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= length).drop("__n")
        kept = tail.withColumn("judged", F.lit(True)).unionByName(waiting.filter(~ready))
        kept.write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")
        for old in (f"{base}/state/batch={batch_id - 2}", staged):
            remove(spark, old)

    return write


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the stream of a checkpoint; a new checkpoint has another."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def deduplicated(
    alerts: DataFrame, time: str = "alert_time", key: str = "alert_key", remember: str = "30 days"
) -> DataFrame:
    """Each alert key once within the time it is remembered."""
    return alerts.withWatermark(time, remember).dropDuplicatesWithinWatermark([key])


LEDGER = T.StructType(
    [T.StructField("alert_key", T.StringType()), T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())]
)


def new_alerts(
    ledger_path: str,
    out_path: str,
    checkpoint: str,
    day: str | None = None,
    buckets: int = 16,
    remember: int | None = None,
    tries: int = 5,
) -> Callable[[DataFrame, int], None]:
    """Sink for ``foreachBatch``: writes alerts not yet in the ledger, then adds their keys.

    The output has a folder per checkpoint and batch, so a repeated batch
    overwrites its own output and never that of another stream. The ledger is a
    table in versions, one file for each of its parts, so what a batch reads
    does not grow with the number of batches before it. ``day`` names a date
    column that is the same for the same key: the parts are days then, else
    ``buckets`` parts by hash. A batch reads and replaces its own parts only;
    days more than ``remember`` days before the batch's newest are forgotten.

    Of two streams with one ledger, the one whose version comes second judges
    its batch again, so no alert is passed on by both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run, staged = checkpoint_id(spark, checkpoint), work_path(spark, "alerts")
        named = batch.withColumn("__day", F.col(day).cast("date") if day else F.lit(None).cast("date"))
        named.write.parquet(staged)
        alerts = spark.read.parquet(staged)
        out = f"{out_path}/run={run}/batch={batch_id}"
        try:
            for attempt in range(tries):
                try:
                    _pass_on(spark, alerts, ledger_path, out, run, batch_id, buckets, remember)
                    break
                except versions.VersionTaken:
                    if attempt == tries - 1:
                        raise
        finally:
            remove(spark, staged)
        versions.expire(spark, ledger_path)

    return write


def _pass_on(
    spark: SparkSession, alerts: DataFrame, ledger_path: str, out: str, run: str, batch_id: int, buckets: int, remember: int | None
) -> None:
    """Write the alerts the ledger lacks, and the ledger's next version with their keys."""

    def part(day: str) -> Column:
        by_hash = F.format_string("b%03d", F.pmod(F.xxhash64("alert_key"), F.lit(buckets)))
        return F.coalesce(F.date_format(day, "yyyyMMdd"), by_hash)

    before = versions.version(spark, ledger_path)
    # One entry for each day or bucket of the batch.
    touched = {r[0] for r in alerts.select(part("__day")).distinct().collect()}
    own = F.col("run").eqNullSafe(run) & F.col("batch").eqNullSafe(batch_id)
    known = versions.read(spark, ledger_path, before, touched) if before else spark.createDataFrame([], LEDGER)
    others = known.filter(~own)
    fresh = unsent(alerts, others)
    days = [] if "day" in alerts.columns else [F.col("__day").alias("day")]
    fresh.select(*[c for c in alerts.columns if c != "__day"], *days).write.mode("overwrite").parquet(out)
    passed_on = alerts.join(spark.read.parquet(out).select("alert_key"), "alert_key", "left_semi").dropDuplicates(["alert_key"])
    added = passed_on.select("alert_key", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"), F.col("__day").alias("day"))
    gone = []
    if before and remember is not None:
        listed = {p for p in {*touched, *before.periods} if p.isdigit()}
        newest = datetime.strptime(max(listed), "%Y%m%d") if listed else None
        gone = [p for p in before.periods if newest and p.isdigit() and p < f"{newest - timedelta(days=remember):%Y%m%d}"]
    rows = others.unionByName(added).withColumn("__part", part("day"))
    versions.replace(spark, ledger_path, before, rows, LEDGER, "__part", gone)


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """All keys of the ledger, with the run and batch that passed them on."""
    return versions.read(spark, ledger_path, versions.version(spark, ledger_path))
