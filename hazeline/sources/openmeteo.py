"""Payload reader for the gridded weather and air-quality provider: hourly arrays and a current block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.functions import numbers as N
from hazeline.functions import payload as J

# Record column to provider field.
WEATHER = {
    "temperature": "temperature_2m",
    "humidity": "relative_humidity_2m",
    "pressure": "pressure_msl",
    "wind_speed": "wind_speed_10m",
    "wind_direction": "wind_direction_10m",
    "cloud_cover": "cloud_cover",
    "rain": "rain",
}
AIR = {
    "aqi": "us_aqi",
    "pm25": "pm2_5",
    "pm10": "pm10",
    "co": "carbon_monoxide",
    "no2": "nitrogen_dioxide",
    "so2": "sulphur_dioxide",
    "o3": "ozone",
    "nh3": "ammonia",
}


def live(payload: Column, now: Column) -> tuple[dict[str, Column], Column]:
    """Weather from the current block; air values are the first of each hourly array, whatever its hour."""
    current = J.at(payload, "$.weather.current")
    time = J.at(payload, "$.weather.current.time")
    hourly = {c: J.first_of(J.at(payload, f"$.air_quality.hourly.{f}")) for c, f in {**AIR, "time": "time"}.items()}
    first_hour, no_hour = hourly.pop("time")
    values = {
        "timestamp": F.coalesce(
            F.when(J.truthy(time), time.cast("string")), F.when(J.truthy(first_hour), first_hour.cast("string")), now
        ),
        "status": F.lit("success"),
        **{c: J.at(payload, f"$.weather.current.{f}") for c, f in WEATHER.items()},
        **{c: first for c, (first, _) in hourly.items()},
    }
    # The hours are only looked at where the current block has no time.
    shapeless = J.any_of([*[none for _, none in hourly.values()], ~J.truthy(time) & no_hour])
    return values, F.when(~J.is_object(current), F.lit("current weather is not an object")).when(
        shapeless, F.lit("hourly values are not a list")
    )


def _arrays(fields: dict[str, str]) -> str:
    return f"struct<{', '.join(f'{f}: array<double>' for f in fields.values())}>"


# Documents of a historical payload, read once per call.
DOCUMENTS = {
    "weather": ("$.weather.hourly", _arrays(WEATHER)),
    "air": ("$.air_quality.hourly", _arrays(AIR)),
}


def series(documents: dict[str, Column]) -> dict[str, Column]:
    """Hourly values by record column."""
    return {c: documents["weather"][f] for c, f in WEATHER.items()} | {c: documents["air"][f] for c, f in AIR.items()}


def history(
    payload: Column, documents: dict[str, Column], means: dict[str, Column], day: Column
) -> tuple[dict[str, Column], Column]:
    """Daily means over the hours that have a value."""
    paths = {c: f"$.weather.hourly.{f}" for c, f in WEATHER.items()} | {
        c: f"$.air_quality.hourly.{f}" for c, f in AIR.items()
    }
    whole = means | {"aqi": N.half_even(means["aqi"]).try_cast("bigint")}
    values = {
        "timestamp": day,
        "status": F.lit("success"),
        **{c: m.cast("variant") for c, m in whole.items()},
    }
    # A field that is present but no list of numbers cannot be averaged; a missing field is no problem.
    bad = [J.not_numbers(payload, paths[c], array) for c, array in series(documents).items()]
    return values, F.when(J.any_of(bad), F.lit("hourly values are not numbers"))
