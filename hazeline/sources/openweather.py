"""Payload reader for the weather and pollution provider: nested items, one live or a list per day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.functions import numbers as N
from hazeline.functions import payload as J

# Record column to path inside a weather item, and to a pollution component.
WEATHER = {
    "temperature": "main.temp",
    "humidity": "main.humidity",
    "pressure": "main.pressure",
    "wind_speed": "wind.speed",
    "wind_direction": "wind.deg",
    "cloud_cover": "clouds.all",
}
AIR = {
    "pm25": "pm2_5",
    "pm10": "pm10",
    "co": "co",
    "no": "no",
    "no2": "no2",
    "so2": "so2",
    "o3": "o3",
    "nh3": "nh3",
}
_BLOCKS = ("main", "wind", "clouds", "rain")


def _present_but_no_object(value: Column) -> Column:
    return F.coalesce(~J.is_object(value), F.lit(False))


def _rain(item: Column, prefix: str = "$") -> Column:
    """One hour of rain, or three when that is zero or absent."""
    hour = J.at(item, f'{prefix}.rain["1h"]')
    return F.when(J.truthy(hour), hour).otherwise(J.at(item, f'{prefix}.rain["3h"]'))


def live(payload: Column, now: Column) -> tuple[dict[str, Column], Column]:
    pollution = "$.air_quality.list[0]"
    values = {
        "timestamp": now,
        "status": F.lit("success"),
        **{c: J.at(payload, f"$.weather.{p}") for c, p in WEATHER.items()},
        "rain": _rain(payload, "$.weather"),
        "aqi": J.at(payload, f"{pollution}.main.aqi"),
        **{c: J.at(payload, f"{pollution}.components.{f}") for c, f in AIR.items()},
    }
    blocks = [J.at(payload, f"$.weather.{b}") for b in _BLOCKS] + [J.at(payload, f"{pollution}.components")]
    main = J.at(payload, f"{pollution}.main")
    broken = J.any_of([*[_present_but_no_object(b) for b in blocks], _present_but_no_object(main) & J.truthy(main)])
    listed = J.at(payload, "$.air_quality.list")
    _, shapeless = J.first_of(listed)
    return values, F.when(shapeless, F.lit("pollution list is not a list")).when(
        broken, F.lit("a weather or pollution block is not an object")
    )


# Documents of a historical payload, read once per call. Rain stays a VARIANT: most items have none.
DOCUMENTS = {
    "weather": (
        "$.weather.list",
        "array<struct<main: struct<temp: double, humidity: double, pressure: double>, "
        "wind: struct<speed: double, deg: double>, clouds: struct<`all`: double>, rain: variant>>",
    ),
    "air": (
        "$.air_quality.list",
        f"array<struct<main: struct<aqi: double>, components: struct<{', '.join(f'`{f}`: double' for f in AIR.values())}>>>",
    ),
}


def _strict_items(payload: Column, path: str, items: Column, blocks: dict[str, list[str]]) -> Column:
    """True when an item has a block that is no object, or a block has a value that is no number.

    ``items`` is the same list read as numbers: where it has a null, a block or a value must be missing.
    """
    found = F.try_variant_get(payload, path, f"array<struct<{', '.join(f'{b}: variant' for b in blocks)}>>")

    def broken(item: Column) -> Column:
        number, whole = item["items"], item["found"]
        tests = [number[b].isNull() & whole[b].isNotNull() for b in blocks]
        return J.any_of(tests + [number[b][f].isNull() & J.is_value(J.at(whole[b], f"$.{f}")) for b, fields in blocks.items() for f in fields])

    return F.exists(F.arrays_zip(items.alias("items"), found.alias("found")), broken)


def _has_gap(items: Column, blocks: dict[str, list[str]]) -> Column:
    """True when an item lacks one of the values; only then can something be wrong with it."""
    return F.exists(items, lambda x: J.any_of([x[b][f].isNull() for b, fields in blocks.items() for f in fields]))


def series(documents: dict[str, Column]) -> dict[str, Column]:
    """Values of the day's items by record column."""
    weather, air = documents["weather"], documents["air"]
    inner = {c: p.split(".") for c, p in WEATHER.items()}
    rain = F.transform(_rains(weather), lambda r: N.falsy_or(J.number_at(r, '$["1h"]'), J.number_at(r, '$["3h"]')))
    return {
        **{c: weather[block][field] for c, (block, field) in inner.items()},
        "rain": rain,
        "aqi": air["main"]["aqi"],
        **{c: air["components"][f] for c, f in AIR.items()},
    }


def _rains(weather: Column) -> Column:
    return F.filter(weather["rain"], lambda r: r.isNotNull())


def history(
    payload: Column, documents: dict[str, Column], means: dict[str, Column], day: Column
) -> tuple[dict[str, Column], Column]:
    """Daily means over the items. The time stamp is that of the first weather item, else the day."""
    weather, air = documents["weather"], documents["air"]
    first_dt = J.at(payload, "$.weather.list[0].dt")
    epoch = F.try_variant_get(payload, "$.weather.list[0].dt", "bigint")
    stamp = F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    values = {
        "timestamp": F.coalesce(stamp, day),
        "status": F.lit("success"),
        **{c: m.cast("variant") for c, m in means.items()},
    }
    weather_blocks: dict[str, list[str]] = {}
    for path in WEATHER.values():
        block, field = path.split(".")
        weather_blocks.setdefault(block, []).append(field)
    air_blocks = {"components": list(AIR.values()), "main": ["aqi"]}
    bad_rain = F.exists(
        _rains(weather),
        lambda r: _present_but_no_object(r) | J.not_a_number(J.at(r, '$["1h"]')) | J.not_a_number(J.at(r, '$["3h"]')),
    )
    broken = J.any_of([
        _has_gap(weather, weather_blocks) & _strict_items(payload, "$.weather.list", weather, weather_blocks),
        bad_rain,
        _has_gap(air, air_blocks) & _strict_items(payload, "$.air_quality.list", air, air_blocks),
        first_dt.isNotNull() & ~F.is_variant_null(first_dt) & epoch.isNull(),
    ])
    # A missing weather list is tolerated; a missing pollution list is not (unless the document is a bare list or value).
    listed, document = J.at(payload, "$.air_quality.list"), J.at(payload, "$.air_quality")
    no_list = F.when(
        listed.isNull(), ~J.truthy(document) | (J.kind(document) == "OBJECT")
    ).otherwise(J.kind(listed).isin("VOID", *J.NUMERIC_KINDS))
    problem = F.when(air.isNull() & F.coalesce(no_list, F.lit(True)), F.lit("pollution list is missing")).when(
        broken, F.lit("a weather or pollution block is not what it should be")
    )
    return values, problem
