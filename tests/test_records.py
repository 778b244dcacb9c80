"""Cleaning, stamping and validation of records."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from hazeline.operators.clean import clean
from hazeline.operators.features import feature_rows
from hazeline.operators.standardize import standardize
from hazeline.operators.survivors import first_by_arrival
from hazeline.operators.validate import RECORD_DATE, check, with_record_date
from tests.landing import RUN

BASE = {"city": "Alder", "country": "AA", "latitude": 1.0, "longitude": 2.0, "timestamp": "2024-01-01T10:00:00Z",
        "data_date": None, "source": "openmeteo", "status": "success", "response_time_seconds": 0.5, "raw_payload": "{}"}
TEXT = ", ".join(f"{k} {'double' if k in ('latitude', 'longitude', 'response_time_seconds') else 'string'}" for k in BASE)


def run(spark, cases, measures, **typed):
    """Check records given as overrides of BASE; ``measures`` are JSON texts read as VARIANT."""
    rows = [(i, *({**BASE, **{k: v for k, v in c.items() if k in BASE}}).values(), *[c.get(m) for m in measures]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"ord bigint, {TEXT}" + "".join(f", {m} string" for m in measures))
    df = df.withColumns({m: F.try_parse_json(m) for m in measures}) if measures else df
    cleaned = clean(df, keep=("ord",))
    checked = check(standardize(with_record_date(cleaned), RUN), keep=("ord", RECORD_DATE))
    return {r.ord: r for r in checked.drop("lineage").collect()}


MEASURE_CASES = [
    # field, JSON value, expected value, expected rule
    ("pm10", "-999", None, None),
    ("pm10", "9999.0", None, None),
    ("temperature", "-9999", -9999.0, "temperature:range"),
    ("co", "-1.5", None, None),
    ("co", '"-1.5"', -1.5, "co:range"),
    ("co", '"9999"', 9999.0, None),
    ("co", '" N/A "', None, None),
    ("co", "[1]", None, "co:type"),
    ("co", "true", 1.0, None),
    ("aqi", "2.5", 2, None),
    ("aqi", "3.5", 4, None),
    ("aqi", "-0.4", 0, None),
    ("aqi", "-3", None, None),
    ("aqi", "-3.0", -3, "aqi:range"),
    ("aqi", '"12"', 12, None),
    ("aqi", '"12.0"', 12, None),
    ("aqi", '"12.5"', None, "aqi:type"),
    ("aqi", '"-"', None, "aqi:type"),
    ("aqi", "-999.0", None, None),
    ("humidity", "100", 100.0, None),
    ("humidity", "100.5", 100.5, "humidity:range"),
    ("wind_direction", "null", None, None),
]


def test_measures(spark):
    fields = sorted({c[0] for c in MEASURE_CASES})
    got = run(spark, [{field: body} for field, body, _, _ in MEASURE_CASES], fields)
    for i, (field, body, value, rule) in enumerate(MEASURE_CASES):
        assert (getattr(got[i], field), got[i].errors) == (value, [rule] if rule else []), (field, body)


def test_text_time_and_payload(spark):
    cases = [
        ({"country": " n/a "}, []),
        ({"city": "  "}, ["city:required"]),
        ({"timestamp": "someday"}, ["timestamp:type"]),
        ({"timestamp": None}, ["timestamp:required"]),
        ({"latitude": 91.0}, ["latitude:range"]),
        ({"latitude": None}, ["latitude:required"]),
        ({"latitude": float("nan")}, ["latitude:range"]),
        ({"raw_payload": '{"a":1}'}, []),
        ({"raw_payload": "[1]"}, []),
        ({"raw_payload": "oops"}, []),
        ({"raw_payload": "5"}, ["raw_payload:type"]),
        ({"response_time_seconds": -0.5}, ["response_time_ms:range", "response_time_seconds:range"]),
        ({"response_time_seconds": None}, []),
        ({"data_date": "2024-01-05"}, []),
        ({"data_date": "soon"}, ["data_date:type"]),
        ({"city": "  ", "latitude": -91.0}, ["city:required", "latitude:range"]),
    ]
    got = run(spark, [c for c, _ in cases], [])
    for i, (case, errors) in enumerate(cases):
        assert got[i].errors == errors, case
    assert got[0].country is None and got[9].raw_payload is None and got[8].raw_payload == "[1]"
    assert got[12].response_time_ms == 0 and got[0].response_time_ms == 500
    assert got[13].record_date == date(2024, 1, 5) and got[0].record_date == date(2024, 1, 1) and got[0].data_date is None


def test_number_columns(spark):
    """Typed columns follow the same rules at plan time."""
    rows = [(0, -9999.0, float("nan"), 2.5, -4), (1, -1.0, 5.0, float("nan"), 9999), (2, 3.0, 5.0, -3.0, 7)]
    df = spark.createDataFrame(rows, "ord bigint, pm25 double, humidity double, aqi double, no2 int")
    got = {r.ord: r for r in clean(df, keep=("ord",)).collect()}
    assert (got[0].pm25, got[0].aqi, got[0].no2) == (None, 2.0, None)
    assert (got[1].pm25, got[1].no2) == (None, None) and got[1].aqi != got[1].aqi
    assert (got[2].pm25, got[2].aqi, got[2].no2) == (3.0, -3.0, 7)
    checked = {r.ord: r.errors for r in check(df, keep=("ord",)).collect()}
    assert "humidity:range" in checked[0] and "aqi:type" in checked[1] and "aqi:range" in checked[2]


def test_api_versions(spark):
    history = ["https://history.openweathermap.org/data/3.0/history/result"]
    rows = [(0, "openweather", history), (1, "openweather", ["x"]), (2, "openweather", None), (3, "openmeteo", history), (4, "other", None)]
    df = spark.createDataFrame([(*r, "Alder", 0.1) for r in rows], "ord int, source string, endpoint array<string>, city string, response_time_seconds double")
    got = {r.ord: r.api_version for r in standardize(df, RUN).collect()}
    assert got == {0: "3.0", 1: "2.5", 2: "2.5", 3: "v1", 4: None}
    lineage = standardize(df, RUN).filter("ord = 0").select("lineage.*").first()
    assert (lineage.source_api, lineage.endpoint, lineage.api_version, lineage.response_time_ms) == ("openweather", history, "3.0", 100)


@pytest.mark.parametrize("partitions", [1, 4])
def test_first_by_arrival(spark, partitions):
    rows = [(3, "A", None, "2024-01-01", "s"), (1, "A", None, "2024-01-01", "s"), (2, "A", None, "2024-01-01T00:00:00", "s"),
            (5, " A", None, "2024-01-01", "s"), (4, "A", "2024-01-01", "2024-01-01", "s"), (6, "A", None, "2024-01-01", "t")]
    df = spark.createDataFrame(rows, "ord bigint, city string, data_date string, timestamp string, source string").repartition(partitions)
    assert sorted(r.ord for r in first_by_arrival(df).collect()) == [1, 2, 4, 5, 6]


def test_feature_rows(spark):
    df = spark.createDataFrame([("A", "2024-01-01", "x", "1.5", ["merged"], 7)], "city string, data_date string, timestamp string, co string, endpoint array<string>, extra int")
    out = feature_rows(df, "r1")
    assert out.columns == ["timestamp", "data_date", "city", "co", "endpoint", "run_id"]
    r = out.first()
    assert (r.timestamp, r.co, r.endpoint, r.run_id, str(r.data_date)) == (None, 1.5, "merged", "r1", "2024-01-01 00:00:00")
