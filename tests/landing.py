"""Landed calls for scenarios: two cities, three providers, live and historical."""

import json
from datetime import datetime, timezone
from pathlib import Path

from hazeline.operators.standardize import Run

RUN = Run("20240102_000000_test", datetime(2024, 1, 2, 8, 30, tzinfo=timezone.utc))
CITIES = [("Alder", 10.5, 20.5, "AA"), ("Birch", 11.5, 21.5, " n/a ")]


def call(ord, source, city, payload, data_date=None, errors=(), seconds=0.25, endpoint=("https://example.org/a",)):
    body = payload if isinstance(payload, str) else json.dumps(payload)
    return {"ord": ord, "source": source, "city": city, "payload": body, "data_date": data_date,
            "errors": list(errors), "response_time_seconds": seconds, "endpoint": list(endpoint)}


def ow_live(temp=20.0, aqi=2, rain=None, **components):
    comp = {"pm2_5": 10.5, "pm10": 20.5, "co": 200.5, "no": 0.5, "no2": 5.5, "so2": 1.5, "o3": 30.5, "nh3": 0.25} | components
    return {"weather": {"main": {"temp": temp, "humidity": 50, "pressure": 1010}, "wind": {"speed": 3.5, "deg": 90},
                        "clouds": {"all": 75}, "rain": {"1h": 0, "3h": 2} if rain is None else rain},
            "air_quality": {"list": [{"main": {"aqi": aqi}, "components": comp}]}}


def om_live(time="2024-01-02T08:00", temp=21.0, **hourly):
    air = {"time": ["2024-01-02T00:00", "2024-01-02T01:00"], "pm10": [31.0, 99.0], "pm2_5": [12.0, 99.0],
           "carbon_monoxide": [210.0, 99.0], "nitrogen_dioxide": [6.0, 99.0], "ozone": [40.0, 99.0],
           "sulphur_dioxide": [2.0, 99.0], "ammonia": [None, 99.0], "us_aqi": [57, 99]} | hourly
    return {"weather": {"current": {"time": time, "temperature_2m": temp, "relative_humidity_2m": 55, "pressure_msl": 1011.5,
                                    "wind_speed_10m": 4.0, "wind_direction_10m": 100, "cloud_cover": 80, "rain": 0.0}},
            "air_quality": {"hourly": air}}


def aq_live(aqi=80, data=None, **iaqi):
    readings = {k: {"v": v} for k, v in ({"pm25": 70, "no2": 9.5} | iaqi).items()}
    return {"aqi": {"status": "ok", "data": {"aqi": aqi, "iaqi": readings} if data is None else data}}


def om_day(bad=False):
    weather = {f: [500.0] if bad else [1.0, None, 2.5] for f in ["temperature_2m", "relative_humidity_2m", "pressure_msl", "wind_speed_10m",
                                            "wind_direction_10m", "cloud_cover"]} | {"rain": []}
    air = {"pm10": [1, 2], "pm2_5": [1.00005, 2.0], "carbon_monoxide": [None, None], "nitrogen_dioxide": [3.0],
           "ozone": [4.0], "sulphur_dioxide": [5.0], "ammonia": [None], "us_aqi": [2, 3]}
    return {"weather": {"hourly": weather}, "air_quality": {"hourly": air}}


def ow_day(weather=True, pollution=True, second=0):
    items = [{"dt": 1704103200 + second, "main": {"temp": 10, "humidity": 40, "pressure": 1000}, "wind": {"speed": 1, "deg": 10},
              "clouds": {"all": 1}, "rain": {"1h": 0, "3h": 2}}, {"dt": 1704106800, "main": {"temp": 13}}]
    air = [{"main": {"aqi": 1}, "components": {"co": 1.0}}, {"main": {"aqi": 2}, "components": {"co": 2.0, "no": None}}]
    return {"weather": {"list": items} if weather else None, "air_quality": {"list": air} if pollution else None}


def land(folder, calls, name="calls.json", extra_lines=()):
    Path(folder).mkdir(parents=True, exist_ok=True)
    lines = [json.dumps(c) for c in calls] + list(extra_lines)
    (Path(folder) / name).write_text("\n".join(lines) + "\n")
    return str(folder)
