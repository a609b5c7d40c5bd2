"""Names, fixed values and schemas shared by all modules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Sites from south to north: name, latitude, longitude, region.
SITES = [
    ("Malmö", 55.605, 13.003, "South"),
    ("Göteborg", 57.709, 11.974, "South"),
    ("Stockholm", 59.329, 18.069, "Middle"),
    ("Uppsala", 59.858, 17.639, "Middle"),
    ("Umeå", 63.826, 20.263, "North"),
    ("Luleå", 65.584, 22.155, "North"),
]

# Species in the order of their seasons; the last three carry weather analyses.
SPECIES = ["alder", "birch", "grass", "mugwort"]
WEATHER_SPECIES = ["birch", "grass", "mugwort"]

ZONE = "Europe/Stockholm"

# Variables per source.
SOURCES = {
    "air_quality": [
        "alder_pollen", "birch_pollen", "grass_pollen", "mugwort_pollen",
        "pm2_5", "pm10", "ozone", "nitrogen_dioxide",
    ],
    "weather": [
        "temperature_2m", "relative_humidity_2m", "precipitation",
        "wind_speed_10m", "wind_direction_10m",
    ],
}

# Daily-mean levels (strict >) of a day that counts as high, per species.
HIGH = {"alder": 100.0, "birch": 100.0, "grass": 30.0, "mugwort": 30.0}
MODERATE = 10.0

# Guideline limits (strict >): daily mean of fine particles, 8 h mean of ozone.
PM25_LIMIT = 15.0
OZONE_LIMIT = 100.0

RAINY_MM = 1.0
HOT_C = 25.0

# Measured seasons used to validate the model: first and last year, then mean
# and yearly trend of start, peak, end (day of year) and of the yearly sum.
MEASURED_COLUMNS = [
    "pollen_type", "first_year", "last_year", "start", "start_trend", "peak",
    "peak_trend", "end", "end_trend", "spin", "spin_trend",
]
MEASURED_SEASONS = [
    ("Alder", 1998, 2024, 69.83, 0.047, 83.56, 0.11, 110.03, 1.17, 1442.33, 35.25),
    ("Birch", 1973, 2024, 117.85, -0.31, 126.23, -0.29, 146.17, -0.14, 8853.00, 78.84),
    ("Grass", 1973, 2024, 156.88, -0.10, 179.71, -0.22, 232.21, 0.24, 1232.20, 8.67),
    ("Mugwort", 1973, 2024, 197.71, -0.12, 216.12, 0.016, 243.23, 0.65, 188.10, -0.08),
]

# Right-closed bins (lo, hi] and their labels.
RAIN_BINS = ([-1, 0.1, 2, 1000], ["Dry", "Light rain", "Rainy"])
WIND_BINS = ([-1, 10, 15, 20, 1000], ["<10 km/h", "10–15", "15–20", ">20 km/h"])
TEMPERATURE_BINS = (
    [-50, 10, 15, 20, 25, 50],
    ["<10 °C", "10–15", "15–20", "20–25", ">25 °C"],
)

CAUSES = ["Ozone", "PM2.5 (fine particles)"]
FACTOR_RAIN = "Rain (≥ 1 mm)"
FACTOR_AIR = "Bad air (PM2.5 or ozone)"
FACTOR_HOT = "Hot (≥ 25 °C)"
# ----------------------------------------------------------------------------


def daily_columns(species: Sequence[str] = SPECIES) -> dict[str, str]:
    """Species name -> its daily-mean column in the daily table."""
    return {s: f"{s}_pollen_avg" for s in species}


def hourly_columns(species: Sequence[str] = SPECIES) -> dict[str, str]:
    """Species name -> its column in the hourly table."""
    return {s: f"{s}_pollen" for s in species}


def subset(columns: Mapping[str, str], names: Sequence[str]) -> dict[str, str]:
    return {name: columns[name] for name in names}


def raw_schema(variables: Sequence[str]) -> T.StructType:
    """Schema of a raw table: one DOUBLE per variable, times without zone in UTC."""
    return T.StructType(
        [
            T.StructField("city", T.StringType(), False),
            T.StructField("time", T.TimestampNTZType(), False),
            *[T.StructField(v, T.DoubleType()) for v in variables],
            T.StructField("loaded_at", T.TimestampNTZType()),
        ]
    )


LOAD_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_at", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("rows_loaded", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def site_dimension(spark, sites=SITES):
    """Site dimension with its south-to-north order: one row per configured site."""
    return spark.createDataFrame(
        [(name, lat, lon, region, i) for i, (name, lat, lon, region) in enumerate(sites)],
        "city string, latitude double, longitude double, region string, ord int",
    )


def measured_seasons(spark):
    """The measured reference seasons as a DataFrame, one row per species."""
    doubles = ", ".join(f"`{c}` double" for c in MEASURED_COLUMNS[3:])
    return spark.createDataFrame(
        MEASURED_SEASONS, f"pollen_type string, first_year int, last_year int, {doubles}"
    )
