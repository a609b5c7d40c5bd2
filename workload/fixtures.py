"""Observation tables derived from the given tables, whole.

The given tables hold no observations, so orders and events stand in for them:
a region (or nation) is a site, a line item is a reading. Each function here
has its SQL counterpart of the same name in ``workload.sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.session import work_path

SPECIES_FLAGS = {"alder": "A", "birch": "N", "grass": "R"}

# Levels that some days of the stand-in data exceed.
HIGH = {"alder": 92.0, "birch": 92.0, "grass": 92.0, "mugwort": 140.0}
MODERATE = 35.0
OZONE = 60.0
PM25 = 7.0


# Declared, so that opening a table reads no file footer.
SCHEMAS = {
    "lineitem": """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "orders": """o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "customer": """c_custkey long, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": """event_id long, ts timestamp_ntz, user_id long, event_type string,
        value double, props string""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a work table, for queries that use it more than once: it is computed only once."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def site_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the region and nation of their customer.

    The orders meet their customers first, so the lines are moved once only.
    """
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        sites(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"
    )


def regions_of(spark: SparkSession, sf: str) -> DataFrame:
    """Region of each nation: the site dimension of the nation-level tables."""
    return sites(spark, sf).select(F.col("n_name").alias("city"), F.col("r_name").alias("region"))


def _quantity(condition: Column | None = None) -> Column:
    q = F.col("l_quantity")
    return q if condition is None else F.when(condition, q)


def _species(agg) -> dict[str, Column]:
    conditions = {s: F.col("l_returnflag") == f for s, f in SPECIES_FLAGS.items()}
    conditions["mugwort"] = F.col("l_linestatus") == "F"
    return {s: agg(_quantity(c)) for s, c in conditions.items()}


def obs_daily(spark: SparkSession, sf: str, site: str = "r_name") -> DataFrame:
    """Daily table: site × ship date. All measures are whole numbers."""
    zero = F.lit(0.0)
    aggs = []
    for s, c in _species(F.sum).items():
        aggs.append(F.coalesce(c, zero).alias(f"{s}_pollen_avg"))
    for s, c in _species(F.max).items():
        aggs.append(F.coalesce(c, zero).alias(f"{s}_pollen_max"))
    line = F.col("l_linenumber").cast("double")
    wet = F.when(F.col("l_linestatus") == "F", 1)
    dry = F.when(F.col("l_linestatus") == "O", 1)
    return (
        site_lines(spark, sf)
        .groupBy(F.col(site).alias("city"), F.to_date("l_shipdate").alias("date_local"))
        .agg(
            *aggs,
            F.count(F.lit(1)).cast("double").alias("pm2_5_avg"),
            F.sum(line).alias("ozone_avg"),
            F.count(dry).cast("double").alias("no2_avg"),
            F.min("l_quantity").alias("temperature_avg_c"),
            F.max("l_quantity").alias("temperature_max_c"),
            F.min(line).alias("humidity_avg_pct"),
            F.count(wet).cast("double").alias("precipitation_mm"),
            F.max(line).alias("wind_speed_avg_kmh"),
            F.count(F.lit(1)).alias("n_hours"),
        )
    )


def raw_air(spark: SparkSession, sf: str) -> DataFrame:
    """Raw air table: up to seven readings per region and day, three hours apart.

    A species without a line item in a reading is null.
    """
    return (
        site_lines(spark, sf)
        .groupBy(F.col("r_name").alias("city"), _reading_time("l_shipdate").alias("time"))
        .agg(
            *[c.alias(f"{s}_pollen") for s, c in _species(F.sum).items()],
            F.count(F.lit(1)).cast("double").alias("pm2_5"),
            F.max("l_quantity").alias("pm10"),
            F.sum("l_quantity").alias("ozone"),
            F.min("l_quantity").alias("nitrogen_dioxide"),
        )
        .withColumn("loaded_at", F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))
    )


def raw_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Raw weather table from the order dates, so that some hours have no weather."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = site_lines(spark, sf).join(orders, "o_orderkey")
    dry = F.when(F.col("l_linestatus") == "F", 1)
    return (
        lines.groupBy(F.col("r_name").alias("city"), _reading_time("o_orderdate").alias("time"))
        .agg(
            F.max("l_quantity").alias("temperature_2m"),
            F.min("l_quantity").alias("relative_humidity_2m"),
            F.count(dry).cast("double").alias("precipitation"),
            F.max(F.col("l_linenumber").cast("double")).alias("wind_speed_10m"),
            F.sum("l_quantity").alias("wind_direction_10m"),
        )
        .withColumn("loaded_at", F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))
    )


def _reading_time(day: str) -> Column:
    return F.timestamp_add("HOUR", F.col("l_linenumber") * 3, F.col(day))


def event_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly table: event type × hour, cents as species counts by the size of props.k."""
    k = F.get_json_object("props", "$.k").cast("int")
    cents = F.round(F.col("value") * 100).cast("long")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("city"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"),
        k.alias("k"),
        cents.alias("cents"),
    )

    def part(lo: int, hi: int) -> Column:
        return F.sum(F.when(F.col("k").between(lo, hi), F.col("cents"))).cast("double")

    return events.groupBy("city", "time").agg(
        part(0, 24).alias("alder_pollen"),
        part(25, 49).alias("birch_pollen"),
        part(50, 74).alias("grass_pollen"),
        part(75, 99).alias("mugwort_pollen"),
        F.count(F.lit(1)).alias("n"),
    )


def forecast_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast snapshots per site, one per event type and day, fetched at noon.

    An hour belongs to every snapshot whose span (two days back to three days
    ahead) contains it.
    """
    hours = event_hours(spark, sf).drop("n")
    day = F.date_trunc("day", "time").cast("timestamp_ntz")
    shift = F.explode(F.sequence(F.lit(-3), F.lit(2)))
    fetched = F.timestamp_add("HOUR", F.col("__shift") * 24 + 12, day)
    return hours.withColumn("__shift", shift).select(
        "city", fetched.alias("fetched_at"), "time", *[c for c in hours.columns if c.endswith("_pollen")]
    )


def landed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads per site and day: the hourly arrays as JSON text."""
    hours = event_hours(spark, sf).drop("n")
    variables = [c for c in hours.columns if c.endswith("_pollen")]
    text = F.date_format("time", "yyyy-MM-dd'T'HH:mm")
    packed = (
        hours.select("city", F.to_date("time").alias("start"), text.alias("time"), *variables)
        .groupBy("city", "start")
        .agg(F.sort_array(F.collect_list(F.struct("time", *variables))).alias("rows"))
    )
    arrays = F.struct(*[F.col(f"rows.{c}").alias(c) for c in ["time", *variables]])
    body = F.to_json(F.struct(arrays.alias("hourly")), {"ignoreNullFields": "false"})
    return packed.select("city", "start", body.alias("body"))
