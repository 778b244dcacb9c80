"""City dimension and the provider location ids attached to it."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.contracts import CITY
from hazeline.functions import text as X
from hazeline.operators.survivors import one_per_key

_ARROW = pa.schema([("position", pa.int64()), ("city", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("country", pa.string())])

# The cities collected by default, in collection order.
DEFAULT_CITIES = [
    ("Karachi", 24.8607, 67.0011, "PK"),
    ("Hyderabad", 25.3960, 68.3578, "PK"),
    ("Sukkur", 27.7052, 68.8484, "PK"),
    ("Khairpur Mir's", 27.5295, 68.7592, "PK"),
    ("Larkana", 27.5598, 68.2120, "PK"),
    ("Gambat", 27.3517, 68.5247, "PK"),
    ("Lahore", 31.5204, 74.3587, "PK"),
]


def cities(spark: SparkSession, rows: Sequence[tuple] = DEFAULT_CITIES) -> DataFrame:
    """Dimension rows (name, latitude, longitude, country) with their collection position."""
    # As an Arrow table the rows have a size that Spark knows, so it can choose a broadcast.
    records = [dict(zip(CITY.fieldNames(), (i, *row), strict=True)) for i, row in enumerate(rows)]
    return spark.createDataFrame(pa.Table.from_pylist(records, _ARROW), CITY)


def location_ids(
    settings: DataFrame, mapping: str = "mapping", order: str | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """(key, location_id) from JSON objects of city to id.

    Null ids, blank names and blank ids are dropped, and text that is no JSON object gives nothing. Each pair is kept
    under its name and under its setting key; of equal keys the last one wins, rows of ``settings`` being taken by
    ``order``. ``overrides`` has rows (name, location_id) that come after the JSON settings.
    """
    parsed = F.from_json(F.col(mapping), "map<string,string>")
    row = F.col(order) if order else F.lit(0)
    pairs = settings.select(row.cast("bigint").alias("row"), F.posexplode(F.map_entries(parsed)).alias("position", "pair")).select(
        F.lit(0).alias("stage"), "row", "position", X.strip(F.col("pair.key")).alias("name"), X.strip(F.col("pair.value")).alias("location_id")
    )
    if overrides is not None:
        pairs = pairs.unionByName(overrides.select(
            F.lit(1).alias("stage"), F.lit(0).cast("bigint").alias("row"), F.lit(0).alias("position"),
            X.strip(F.col("name")).alias("name"), X.strip(F.col("location_id")).alias("location_id"),
        ))
    usable = pairs.filter((F.col("name") != "") & (F.col("location_id") != ""))
    keyed = usable.select(
        "stage", "row", "position", "location_id",
        F.posexplode(F.array("name", X.setting_key(F.col("name")))).alias("form", "key"),
    )
    last = [F.col(c).desc() for c in ("stage", "row", "position", "form")]
    return one_per_key(keyed, ["key"], last).select("key", "location_id")


def with_location_id(dim: DataFrame, ids: DataFrame, name: str = "city") -> DataFrame:
    """Attach ``location_id``: by exact name, else (also when that id is empty) by the normalized name."""
    exact = ids.select(F.col("key").alias("_exact"), F.col("location_id").alias("_by_name"))
    normal = ids.select(F.col("key").alias("_normal"), F.col("location_id").alias("_by_key"))
    return (
        dim.join(exact, F.col(name) == F.col("_exact"), "left")
        .join(normal, X.city_key(F.col(name)) == F.col("_normal"), "left")
        .withColumn("location_id", X.first_text(F.col("_by_name"), F.col("_by_key")))
        .drop("_exact", "_by_name", "_normal", "_by_key")
    )


def with_city(df: DataFrame, dim: DataFrame, attributes: Sequence[str] = ("country", "latitude", "longitude")) -> DataFrame:
    """City attributes from the dimension, never from the payload. Unknown cities keep nulls and fail validation."""
    return df.join(dim.select("city", *attributes), "city", "left")


