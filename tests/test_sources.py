"""Payload readers, call status and records."""

import json

import pytest

from hazeline.operators.bronze import bronze, call_log, failed_requests
from hazeline.sources.cities import cities
from hazeline.sources.landed import read_landed, to_calls, to_records
from tests.landing import CITIES, RUN, aq_live, call, land, om_day, om_live, ow_day, ow_live


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    rows = [
        call(0, "openweather", "Alder", ow_live()),
        call(1, "openmeteo", "Alder", om_live()),
        call(2, "aqicn", "Alder", aq_live()),
        call(3, "openweather", "Birch", ow_live(rain={"1h": 0})),
        call(4, "openmeteo", "Birch", om_live(time="")),
        call(5, "aqicn", "Birch", {}),
        call(6, "aqicn", "Birch", aq_live(data="Unknown station")),
        call(7, "openweather", "Alder", ow_day(), "2024-01-01"),
        call(8, "openmeteo", "Alder", om_day(), "2024-01-01"),
        call(9, "openweather", "Birch", ow_day(pollution=False), "2024-01-01", ["air_quality: HTTP 500"]),
        call(10, "openweather", "Birch", ow_day(weather=False), "2024-01-01", ["weather: HTTP 500", "x: y"]),
        call(11, "openmeteo", "Alder", {"weather": {"current": None}}),
        call(12, "openmeteo", "Alder", {"weather": {"hourly": {"rain": "wet"}}}, "2024-01-03"),
        call(13, "openmeteo", "Alder", {"weather": {"hourly": {"rain": None}}}, "2024-01-03"),
        call(14, "elsewhere", "Alder", {}),
        call(15, "aqicn", "Alder", aq_live(aqi="-", co="-1.5")),
        call(16, "aqicn", "Alder", "not json"),
        call(17, "openweather", "Alder", {"weather": {"main": None}, "air_quality": {"list": []}}),
        call(18, "openmeteo", "Alder", {"weather": None, "air_quality": None}, "2024-01-03"),
    ]
    landed = read_landed(spark, land(folder, rows, extra_lines=['{"ord": 99, "source": ']))
    return to_calls(landed, RUN)


@pytest.fixture(scope="module")
def by_ord(calls):
    return {r.ord: r for r in calls.select("ord", "source", "city", "status", "error", "raw_payload").collect()}


@pytest.fixture(scope="module")
def records(spark, calls):
    rows = to_records(calls, cities(spark, CITIES))
    plain = rows.selectExpr(*[f"to_json({n}) AS {n}" if t == "variant" else n for n, t in rows.dtypes])
    return {r.ord: r for r in plain.collect()}


def test_statuses(by_ord):
    expected = {0: "success", 5: "success", 6: "failed", 7: "success", 9: "failed", 10: "partial", 11: "failed",
                12: "failed", 13: "failed", 14: "failed", 16: "failed", 17: "failed", 18: "success"}
    assert {k: by_ord[k].status for k in expected} == expected
    assert by_ord[10].error == "weather: HTTP 500; x: y"
    assert by_ord[0].error is None


def test_malformed_line_is_a_failed_unknown_call(by_ord):
    row = by_ord[None] if None in by_ord else by_ord[99]
    assert (row.source, row.city, row.status, row.raw_payload) == ("unknown", "unknown", "failed", "{}")


def test_openweather_live(records):
    r = records[0]
    assert (r.temperature, r.humidity, r.wind_direction, r.cloud_cover) == ("20", "50", "90", "75")
    assert (r.rain, r.aqi, r.pm25, r.nh3, r.timestamp) == ("2", "2", "10.5", "0.25", RUN.text)
    assert records[3].rain is None  # 1h is zero and there is no 3h
    assert (r.country, r.latitude) == ("AA", 10.5)


def test_openmeteo_live_takes_first_hour(records):
    r = records[1]
    assert (r.timestamp, r.temperature, r.aqi, r.pm10, r.no) == ("2024-01-02T08:00", "21", "57", "31", None)
    assert records[4].timestamp == "2024-01-02T00:00"  # empty time falls back to the first hour


def test_aqicn(records):
    assert (records[2].aqi, records[2].pm25, records[2].pm10, records[2].status) == ("80", "70", None, "success")
    assert (records[5].status, records[5].aqi) == ("failed", None)
    assert 6 not in records
    assert records[15].aqi == '"-"' and records[15].co == '"-1.5"'


def test_openmeteo_history(records):
    r = records[8]
    assert (float(r.temperature), r.rain, r.aqi, r.co, r.timestamp) == (1.75, None, "2", None, "2024-01-01")
    assert float(r.pm10) == 1.5 and str(r.data_date) == "2024-01-01"
    assert all(getattr(records[18], c) is None for c in ("temperature", "aqi", "o3"))


def test_openweather_history(records):
    r = records[7]
    assert (float(r.temperature), float(r.humidity), float(r.rain), float(r.aqi)) == (11.5, 40.0, 2.0, 1.5)
    assert (float(r.co), r.no, r.timestamp) == (1.5, None, "2024-01-01T10:00:00+00:00")
    assert records[10].temperature is None and records[10].timestamp == "2024-01-01"
    assert 9 not in records


def test_bronze_keeps_every_call(calls):
    rows = bronze(calls, RUN).collect()
    assert len(rows) == 20
    by = {(r.source, r.city, r.status): r for r in rows}
    r = by[("openweather", "Alder", "success")]
    assert (r.run_id, r.response_time_ms, r.api_version, r.pipeline_version) == (RUN.run_id, 250, "2.5", "2.2.0")
    assert by[("unknown", "unknown", "failed")].api_version is None


def test_failed_requests_and_log(calls):
    failures = failed_requests(calls).collect()
    assert ("openweather", "Birch", "weather: HTTP 500; x: y") in [tuple(r) for r in failures]
    lines = {r.ord: r.line for r in call_log(calls).collect()}
    assert lines[0] == "City=Alder | API=openweather | Status=SUCCESS | ResponseTime=250ms"
    assert lines[10].endswith("| Reason=weather: HTTP 500; x: y")


def test_payload_text_is_kept(records):
    assert json.loads(records[0].raw_payload) == ow_live()
