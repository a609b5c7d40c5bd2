"""Growth of the main operators with the number of sites, and with one site holding a third.

    python scaling.py [factor ...]     (default 1 10)

Prints seconds per operator and factor, reading stored Parquet. The hot run has
the rows of the largest factor, but one site owns a third of them (a much
longer history).
"""

from __future__ import annotations

import sys
import tempfile
import time

from pyspark.sql import functions as F

from stationlake.model import SPECIES
from stationlake.plans import marts, risk, weather
from stationlake.session import local_session

SITES, HOURS = 25, 8784


def readings(spark, spans: list[tuple[int, int, int]]):
    """Hourly raw rows; ``spans`` lists (first site, sites, hours per site)."""
    parts = []
    for first, sites, hours in spans:
        ids = spark.range(sites * hours)
        parts.append(
            ids.select(
                F.concat(F.lit("s"), (F.expr(f"id div {hours}") + first).cast("string")).alias("city"),
                F.timestamp_add("HOUR", F.col("id") % hours, F.lit("1900-01-01").cast("timestamp_ntz")).alias("time"),
                F.xxhash64("id").alias("h"),
            )
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def measure(i: int, top: int):
        return F.pmod(F.shiftright("h", 4 * i), F.lit(top)).cast("double")

    air = rows.select(
        "city", "time", *[measure(i, 40).alias(f"{s}_pollen") for i, s in enumerate(SPECIES)],
        *[measure(4 + i, 60).alias(c) for i, c in enumerate(["pm2_5", "pm10", "ozone", "nitrogen_dioxide"])],
    )
    wet = F.when(F.pmod(F.xxhash64("city", F.to_date("time")), F.lit(3)) == 0, measure(8, 4)).otherwise(0.0)
    sky = rows.select(
        "city", "time",
        *[measure(9 + i, 30).alias(c) for i, c in enumerate(["temperature_2m", "relative_humidity_2m"])],
        wet.alias("precipitation"), measure(11, 30).alias("wind_speed_10m"), measure(12, 360).alias("wind_direction_10m"),
    )
    return air, sky


def run(spark, folder: str, label: str, spans) -> dict[str, float]:
    air, sky = readings(spark, spans)
    air.write.parquet(f"{folder}/{label}/air")
    sky.write.parquet(f"{folder}/{label}/sky")
    times = {}

    def timed(name, df, store=True):
        start = time.perf_counter()
        if store:
            df.write.parquet(f"{folder}/{label}/{name}")
        else:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 2)
        return spark.read.parquet(f"{folder}/{label}/{name}") if store else None

    staged = [spark.read.parquet(f"{folder}/{label}/{n}") for n in ("air", "sky")]
    hours = timed("hourly", marts.hourly(marts.stage_air_quality(staged[0]), marts.stage_weather(staged[1])))
    days = timed("daily", marts.daily(hours))
    seasons = timed("seasons", marts.seasons(days))
    timed("rolling8", risk.rolling_daily_max(hours), store=False)
    timed("rain_events", weather.rain_events(days, seasons), store=False)
    return times


def main() -> None:
    factors = [int(a) for a in sys.argv[1:]] or [1, 10]
    spark = local_session("8", partitions=32)
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    run(spark, folder, "warm", [(0, SITES, HOURS)])
    for factor in factors:
        print(f"x{factor}", SITES * factor * HOURS, "rows", run(spark, folder, f"x{factor}", [(0, SITES * factor, HOURS)]), flush=True)
    sites = SITES * max(factors)
    third = sites * HOURS // 3
    hot = [(0, sites * 2 // 3, HOURS), (sites, 1, third)]
    print("hot", sites * HOURS, "rows", run(spark, folder, "hot", hot), flush=True)


if __name__ == "__main__":
    main()
