"""Column contracts, value rules and fixed values of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# They have to equal the upstream definitions for results to match.
PIPELINE_VERSION = "2.2.0"
API_VERSIONS = {
    "openweather": "2.5",
    "openweather_history": "3.0",
    "openmeteo": "v1",
    "aqicn": "v1",
}
HISTORY_ENDPOINT = "history.openweathermap.org/data/3.0/history/result"
EARLIEST_BACKFILL = "2023-01-01"
SENTINELS = (-9999.0, -999.0, 9999.0)
NULL_TOKEN = "N/A"
DRIFT_THRESHOLDS = {"temperature": 5.0, "aqi": 10.0, "humidity": 10.0}

WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "cloud_cover", "rain"]
POLLUTANTS = ["aqi", "pm25", "pm10", "co", "no", "no2", "so2", "o3", "nh3"]
MEASURES = WEATHER + POLLUTANTS

# Sources in arrival order within a city; the flag says whether history can be asked for.
SOURCES = [("openweather", True), ("openmeteo", True), ("aqicn", False)]

DEDUP_KEY = ["city", "data_date", "timestamp", "source"]
GOLD_KEY = ["city", "data_date"]


@dataclass(frozen=True)
class Field:
    """One contract column: how it is coerced, whether it may be null, and its bounds."""

    name: str
    kind: str  # number | integer | text | instant | day | endpoints | payload | lineage
    required: bool = False
    low: float | None = None
    high: float | None = None


SILVER_FIELDS = [
    Field("timestamp", "instant", required=True),
    Field("city", "text", required=True),
    Field("country", "text"),
    Field("latitude", "number", required=True, low=-90, high=90),
    Field("longitude", "number", required=True, low=-180, high=180),
    Field("temperature", "number", low=-80, high=70),
    Field("humidity", "number", low=0, high=100),
    Field("pressure", "number", low=0),
    Field("wind_speed", "number", low=0),
    Field("wind_direction", "number", low=0, high=360),
    Field("cloud_cover", "number", low=0, high=100),
    Field("rain", "number", low=0),
    Field("aqi", "integer", low=0),
    *[Field(name, "number", low=0) for name in POLLUTANTS if name != "aqi"],
    Field("source", "text", required=True),
    Field("endpoint", "endpoints"),
    Field("data_date", "day"),
    Field("status", "text", required=True),
    Field("run_id", "text", required=True),
    Field("pipeline_version", "text", required=True),
    Field("api_version", "text"),
    Field("retrieved_at", "instant", required=True),
    Field("response_time_ms", "integer", required=True, low=0),
    Field("response_time_seconds", "number", low=0),
    Field("lineage", "lineage"),
    Field("raw_payload", "payload"),
]
SILVER_COLUMNS = [f.name for f in SILVER_FIELDS]

BRONZE_COLUMNS = [
    "run_id", "source", "endpoint", "city", "status", "pipeline_version", "api_version", "retrieved_at",
    "response_time_ms", "response_time_seconds", "error", "data_date", "raw_payload",
]

FEATURE_COLUMNS = [
    "timestamp", "data_date", "city", "country", "latitude", "longitude", *MEASURES, "source", "endpoint", "status",
    "run_id", "pipeline_version", "api_version", "retrieved_at", "response_time_ms", "response_time_seconds",
]
FEATURE_INSTANTS = ["timestamp", "data_date", "retrieved_at"]
FEATURE_NUMBERS = ["latitude", "longitude", *MEASURES, "response_time_ms", "response_time_seconds"]
FEATURE_TEXTS = ["city", "country", "source", "endpoint", "status", "run_id", "pipeline_version", "api_version"]

CITY = T.StructType([
    T.StructField("position", T.LongType(), False),
    T.StructField("city", T.StringType(), False),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("country", T.StringType()),
])

# One row per provider call. `errors` holds "label: reason" entries; `ord` is the arrival order (unique).
LANDED = T.StructType([
    T.StructField("ord", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("endpoint", T.ArrayType(T.StringType())),
    T.StructField("city", T.StringType()),
    T.StructField("data_date", T.DateType()),
    T.StructField("payload", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("response_time_seconds", T.DoubleType()),
    T.StructField("malformed", T.StringType()),
])

SILVER_LINEAGE = T.StructType([
    T.StructField("source_api", T.StringType()),
    T.StructField("endpoint", T.ArrayType(T.StringType())),
    T.StructField("city", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("retrieved_at", T.TimestampType()),
    T.StructField("response_time_ms", T.IntegerType()),
    T.StructField("response_time_seconds", T.DoubleType()),
    T.StructField("pipeline_version", T.StringType()),
    T.StructField("api_version", T.StringType()),
])

_SILVER_TYPES = {
    "number": T.DoubleType(),
    "integer": T.LongType(),
    "text": T.StringType(),
    "instant": T.TimestampType(),
    "day": T.DateType(),
    "endpoints": T.ArrayType(T.StringType()),
    "payload": T.StringType(),
    "lineage": SILVER_LINEAGE,
}


def field_type(field: Field) -> T.DataType:
    return T.IntegerType() if field.name == "response_time_ms" else _SILVER_TYPES[field.kind]


SILVER = T.StructType([T.StructField(f.name, field_type(f)) for f in SILVER_FIELDS])
