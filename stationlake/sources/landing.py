"""Landed hourly payloads -> rows, with the bookkeeping of an incremental load."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.model import raw_schema


def payload_schema(variables: Sequence[str]) -> str:
    """DDL of a payload: ``hourly`` is a struct of parallel arrays."""
    arrays = ", ".join(f"`{v}`: array<double>" for v in variables)
    return f"hourly struct<`time`: array<string>, {arrays}>"


def read_payloads(
    spark: SparkSession, path: str, seen: DataFrame | None = None, after: datetime | None = None
) -> DataFrame:
    """Payload files below ``city=<name>`` folders, one row each: city, file, modified, body.

    ``seen`` (``file``, ``modified``) is the record of earlier loads: its files are
    left out, unless they have changed since. ``after`` leaves out files last
    changed before that moment when files are listed, so none of them is opened;
    it must not be later than a file may still arrive with. Files without any
    content give no row, as the engine's reader passes over them.
    """
    reader = spark.read.schema("value string, city string").option("wholetext", True)
    if after is not None:
        reader = reader.option("modifiedAfter", after.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    files = reader.text(path).select(
        "city",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("body"),
    )
    return files if seen is None else files.join(seen.select("file", "modified"), ["file", "modified"], "left_anti").select(*files.columns)


def loaded_files(payloads: DataFrame, variables: Sequence[str], loaded_at: Column | datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the sound payload files in the raw schema, and the files set aside.

    A rejected file keeps its content and the reason, also where its folder names
    no site; it gives no rows and does not stop the others.
    """
    named = F.when(F.col("city").isNull(), "no site")
    judged = parsed(payloads, variables).withColumn("problem", F.coalesce(named, "problem"))
    rows = with_lineage(payload_rows(judged, variables), loaded_at)
    raw = [F.col(f.name).cast(f.dataType) for f in raw_schema(variables)]
    rejects = judged.filter(F.col("problem").isNotNull()).select("city", "file", "modified", "problem", "body")
    return rows.select(*raw), rejects


def parsed(payloads: DataFrame, variables: Sequence[str], body: str = "body") -> DataFrame:
    """Payloads with their content (``__p``) and ``problem``, null where there is none.

    A payload is unreadable without its arrays, has uneven arrays when their
    lengths differ, or a bad time when one cannot be read. Rows and log start
    from this, so bodies are parsed once.
    """
    hourly = F.col("__p")["hourly"]
    arrays = [hourly[v] for v in variables]
    missing = F.lit(False)
    uneven = F.lit(False)
    for a in arrays:
        missing = missing | a.isNull()
        uneven = uneven | (F.size(a) != F.size(hourly["time"]))
    bad_time = F.exists(hourly["time"], lambda t: _moment(t).isNull())
    problem = (
        F.when(hourly.isNull() | hourly["time"].isNull() | missing, "unreadable")
        .when(uneven, "uneven arrays")
        .when(bad_time, "bad time")
    )
    return payloads.withColumn("__p", F.from_json(body, payload_schema(variables))).withColumn("problem", problem)


def _moment(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz")


def payload_rows(
    payloads: DataFrame,
    variables: Sequence[str],
    keys: Sequence[str] = ("city",),
    body: str = "body",
) -> DataFrame:
    """One row per hour of each payload without a problem; hours without any value are dropped.

    ``payloads`` may be parsed already. An hour with at least one value stays.
    NaN becomes null.
    """
    if "__p" not in payloads.columns:
        payloads = parsed(payloads, variables, body)
    content = F.when(F.col("problem").isNull(), F.col("__p")["hourly"])
    zipped = F.arrays_zip(content["time"], *[content[v] for v in variables])
    rows = payloads.select(*keys, F.inline(zipped).alias("time", *variables))
    measures = [F.when(~F.isnan(v), F.col(v)).alias(v) for v in variables]
    return rows.select(*keys, _moment(F.col("time")).alias("time"), *measures).dropna(how="all", subset=list(variables))


def with_lineage(rows: DataFrame, loaded_at: Column | datetime | None = None) -> DataFrame:
    """Add ``loaded_at``, the load time in UTC."""
    if loaded_at is None:
        utc = F.convert_timezone(
            F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
        )
    else:
        utc = loaded_at if isinstance(loaded_at, Column) else F.lit(loaded_at)
    return rows.withColumn("loaded_at", utc.cast("timestamp_ntz"))


def next_start(
    target: DataFrame, sites: DataFrame, default: date, keys: Sequence[str] = ("city",)
) -> DataFrame:
    """First day to load per key: the last stored day (it may be incomplete), else the default."""
    last = target.groupBy(*keys).agg(F.max(F.to_date("time")).alias("__last"))
    return sites.join(last, list(keys), "left").select(
        *sites.columns, F.coalesce("__last", F.lit(default)).alias("start")
    )


def year_chunks(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Split each closed date range at the ends of its years; empty ranges give no rows."""
    others = [c for c in ranges.columns if c not in (start, end)]
    year = F.explode(F.sequence(F.year(start), F.year(end)))
    first = F.make_date("__year", F.lit(1), F.lit(1))
    last = F.make_date("__year", F.lit(12), F.lit(31))
    return (
        ranges.filter(F.col(start) <= F.col(end))
        .withColumn("__year", year)
        .select(
            *others,
            F.greatest(F.col(start), first).alias("chunk_start"),
            F.least(F.col(end), last).alias("chunk_end"),
        )
    )


def load_log(
    payloads: DataFrame,
    rows: DataFrame,
    source: str,
    end: date,
    run_at: datetime,
    variables: Sequence[str],
    body: str = "body",
) -> DataFrame:
    """One log row per site of a run; a payload with a problem does not stop the others.

    ``payloads`` carries ``city``, ``body`` and ``start``, the first day asked
    for, and may be parsed already. The error names each kind of problem.
    """
    if "__p" not in payloads.columns:
        payloads = parsed(payloads, variables, body)
    kinds = ["unreadable", "uneven arrays", "bad time"]
    counts = [F.count(F.when(F.col("problem") == k, 1)).alias(f"__{i}") for i, k in enumerate(kinds)]
    state = payloads.groupBy("city").agg(F.min("start").alias("start_date"), F.count("problem").alias("__bad"), *counts)
    loaded = rows.groupBy("city").agg(F.count(F.lit(1)).alias("__rows"))
    bad = F.col("__bad") > 0
    named = [F.when(F.col(f"__{i}") > 0, F.concat(F.col(f"__{i}").cast("string"), F.lit(f" {k}"))) for i, k in enumerate(kinds)]
    message = F.concat(F.concat_ws(", ", *named), F.lit(" payload(s)"))
    return state.join(loaded, "city", "left").select(
        F.lit(run_at).cast("timestamp_ntz").alias("run_at"),
        F.lit(source).alias("source"),
        "city",
        "start_date",
        F.lit(end).alias("end_date"),
        F.coalesce("__rows", F.lit(0)).cast("int").alias("rows_loaded"),
        F.when(bad, "error").otherwise("ok").alias("status"),
        F.when(bad, message).alias("error"),
    )


def last_run(log: DataFrame, zone: str) -> DataFrame:
    """Local time of the last run per source."""
    newest = F.max("run_at")
    return log.groupBy("source").agg(
        F.convert_timezone(F.lit("UTC"), F.lit(zone), newest).alias("last_run_local")
    )
