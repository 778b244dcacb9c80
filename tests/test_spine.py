"""Cities, location ids, spines, gaps and planned requests."""

from datetime import date

from pyspark.sql import functions as F

from hazeline.sources.cities import DEFAULT_CITIES, cities, location_ids, with_city, with_location_id
from hazeline.sources.spine import gaps, history_spine, live_spine, planned_requests
from tests.landing import CITIES

DAY1, DAY3 = date(2024, 1, 1), date(2024, 1, 3)


def test_default_cities(spark):
    rows = cities(spark).orderBy("position").collect()
    assert [r.city for r in rows] == [c[0] for c in DEFAULT_CITIES] and len(rows) == 7


def test_location_ids(spark):
    settings = spark.createDataFrame([('{"Khairpur Mir\'s": " 7 ", "x": null, " ": "1", "y": " ", "Lahore": 5}',), ("oops",), ("[1]",)], "mapping string")
    overrides = spark.createDataFrame([("Lahore", "9"), ("Z", " ")], "name string, location_id string")
    got = {r.key: r.location_id for r in location_ids(settings, overrides=overrides).collect()}
    assert got == {"Khairpur Mir's": "7", "KHAIRPUR_MIR_S": "7", "Lahore": "9", "LAHORE": "9"}


def test_two_step_lookup(spark):
    ids = spark.createDataFrame([("Alder", ""), ("ALDER", "2"), ("Birch", "3"), ("BIRCH", "4")], "key string, location_id string")
    got = {r.city: r.location_id for r in with_location_id(cities(spark, [*CITIES, ("Cedar", 0.0, 0.0, "CC")]), ids).collect()}
    assert got == {"Alder": "2", "Birch": "3", "Cedar": None}


def test_unknown_city_keeps_its_row(spark):
    df = spark.createDataFrame([("Alder",), ("Nowhere",)], "city string")
    assert {r.city: r.latitude for r in with_city(df, cities(spark, CITIES)).collect()} == {"Alder": 10.5, "Nowhere": None}


def test_live_spine_is_city_major(spark):
    rows = live_spine(cities(spark, CITIES)).orderBy("ord").collect()
    assert [(r.city, r.source) for r in rows] == [(c, s) for c in ("Alder", "Birch") for s in ("openweather", "openmeteo", "aqicn")]
    assert all(r.data_date is None for r in rows)


def test_history_spine(spark):
    rows = history_spine(cities(spark, CITIES), F.lit(DAY1), F.lit(DAY3), 2).orderBy("ord").collect()
    assert len(rows) == 12 and {r.source for r in rows} == {"openweather", "openmeteo"}
    assert [(r.data_date.day, r.city, r.source) for r in rows[:5]] == [
        (1, "Alder", "openweather"), (1, "Alder", "openmeteo"), (1, "Birch", "openweather"), (1, "Birch", "openmeteo"), (2, "Alder", "openweather")]
    assert history_spine(cities(spark, CITIES), F.lit(DAY1), F.lit(DAY3), 2, [("aqicn", False)]).count() == 0


def test_gaps(spark):
    spine = history_spine(cities(spark, CITIES), F.lit(DAY1), F.lit(DAY1), 2)
    landed = spine.filter("source = 'openmeteo' AND city = 'Alder'")
    assert sorted((r.city, r.source) for r in gaps(spine, landed.union(landed)).collect()) == [
        ("Alder", "openweather"), ("Birch", "openmeteo"), ("Birch", "openweather")]


def requests(spark, past, **flags):
    dim = with_location_id(cities(spark, CITIES), spark.createDataFrame([("Alder", "77")], "key string, location_id string"))
    spine = history_spine(dim, F.lit(DAY1), F.lit(DAY1), 2) if past else live_spine(dim)
    rows = planned_requests(with_city(spine, dim, ["latitude", "longitude", "location_id"]), **flags).collect()
    return {(r.city, r.source): r.requests for r in rows}


def test_planned_live_requests(spark):
    got = requests(spark, False, station_feed=False)
    assert got["Alder", "aqicn"] == [] and [q.label for q in got["Alder", "openmeteo"]] == ["weather", "air_quality"]
    assert got["Alder", "openweather"][0].params == {"lat": "10.5", "lon": "20.5", "units": "metric"}
    assert got["Alder", "openmeteo"][0].params["current"].startswith("temperature_2m,")
    assert requests(spark, False)["Birch", "aqicn"][0].url.endswith("/feed/Birch/")


def test_planned_history_requests(spark):
    off, on = requests(spark, True), requests(spark, True, weather_history=True)
    assert [q.label for q in off["Alder", "openweather"]] == ["air_quality"]
    assert [q.label for q in on["Alder", "openweather"]] == ["weather", "air_quality"]
    assert [q.label for q in on["Birch", "openweather"]] == ["air_quality"]  # no location id
    assert on["Alder", "openweather"][0].params == {"id": "77", "start": "1704067200", "end": "1704153599"}
    assert on["Alder", "openmeteo"][1].params["start_date"] == "2024-01-01"
