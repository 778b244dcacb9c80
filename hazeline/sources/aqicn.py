"""Payload reader for the station feed: an index and single pollutant readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.functions import payload as J

# Pollutants the feed can carry.
READINGS = ["pm25", "co", "no", "no2", "so2", "o3", "nh3"]


def live(payload: Column, now: Column) -> tuple[dict[str, Column], Column]:
    """Readings of the station. An empty payload is a record of status failed, all null, and no problem."""
    values = {
        "timestamp": now,
        "status": F.when(J.truthy(J.at(payload, "$.aqi")), F.lit("success")).otherwise(F.lit("failed")),
        "aqi": J.at(payload, "$.aqi.data.aqi"),
        **{c: J.at(payload, f"$.aqi.data.iaqi.{c}.v") for c in READINGS},
    }
    data, readings = J.kind(J.at(payload, "$.aqi.data")), J.kind(J.at(payload, "$.aqi.data.iaqi"))
    problem = F.when(data != "OBJECT", F.lit("data is not an object")).when(
        readings != "OBJECT", F.lit("readings are not an object")
    )
    return values, problem
