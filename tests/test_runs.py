"""Whole runs on two cities and three providers: live, backfill, publishing twice, streaming."""

import json
from datetime import date, datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hazeline.operators.standardize import Run
from hazeline.operators.upsert import merge_latest
from hazeline.plans.run import run_backfill, run_live
from hazeline.sinks.snapshots import read_snapshot, write_csv
from hazeline.sinks.tables import read_features
from hazeline.sinks.versions import VersionedTable, read_versioned
from hazeline.sources.cities import cities
from hazeline.sources.landed import of_run, of_window, read_landed, write_landed
from hazeline.sources.spine import check_window
from hazeline.streaming.ingest import ingest
from tests.landing import CITIES, RUN, aq_live, call, land, om_day, om_live, ow_day, ow_live

LIVE = [
    call(0, "openweather", "Alder", ow_live()),
    call(1, "openmeteo", "Alder", om_live()),
    call(2, "aqicn", "Alder", aq_live(aqi="-")),
    call(3, "openweather", "Birch", ow_live(temp=99.0)),  # rejected, so the next source supplies the row
    call(4, "openmeteo", "Birch", om_live(temp=12.0), errors=["air_quality: HTTP 500"]),
    call(5, "aqicn", "Birch", {}),
    call(6, "openmeteo", "Birch", om_live(temp=13.0)),  # same raw key as call 4
    call(7, "aqicn", "Birch", aq_live(data="Unknown station")),
]
PAST = [
    call(10, "openweather", "Alder", ow_day(), "2024-01-01"),
    call(11, "openmeteo", "Alder", om_day(), "2024-01-01"),
    call(12, "openmeteo", "Birch", om_day(), "2024-01-01"),
    call(13, "openmeteo", "Birch", om_day(), "2024-01-02"),
    call(14, "aqicn", "Birch", aq_live(), "2024-01-02"),  # cannot be asked for history
]


def report(base, *parts):
    folder = Path(base).joinpath("reports", *parts)
    lines = [line for f in folder.glob("*.json") for line in f.read_text().splitlines()]
    return json.loads(lines[0]) if lines else None


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("live"))
    landing = land(f"{base}/landing", LIVE + PAST, extra_lines=["{broken"])
    return base, landing, run_live(spark, landing, cities(spark, CITIES), base, RUN)


def test_live_layers(spark, live):
    base, _, published = live
    bronze = read_snapshot(spark, base, "bronze", RUN.run_id)
    assert bronze.count() == 9
    silver, quarantine = (read_snapshot(spark, base, layer, RUN.run_id) for layer in ("silver", "quarantine"))
    assert {r.ord: r.errors for r in quarantine.collect()} == {2: ["aqi:type"], 3: ["temperature:range"]}
    rows = {r.ord: r for r in silver.collect()}
    assert sorted(rows) == [0, 1, 4, 5] and "errors" not in silver.columns
    assert rows[0].data_date is None and rows[0].endpoint is None and rows[5].status == "failed"
    assert rows[1].country == "AA" and rows[4].country is None
    gold = {r.city: r for r in read_snapshot(spark, base, "gold", RUN.run_id).collect()}
    assert gold["Alder"].temperature == 20.0 and gold["Alder"].data_date == date(2024, 1, 2)
    lineage = sorted((r.city, r.ord, r.source) for r in read_snapshot(spark, base, "lineage", RUN.run_id).collect())
    assert [x[::2] for x in lineage] == [("Alder", "openweather"), ("Alder", "openmeteo"), ("Birch", "openmeteo"), ("Birch", "aqicn")]
    assert gold["Alder"].lineage_records == gold["Birch"].lineage_records == 2
    assert gold["Birch"].temperature == 12.0
    assert gold["Birch"].aqi == 57 and gold["Birch"].no is None


def test_live_reports(live):
    base, _, published = live
    run = f"run_id={RUN.run_id}"
    main, quality, metrics = (report(base, run, n) for n in ("pipeline", "quality", "metrics"))
    expected = {"cities_processed": 2, "total_api_calls": 9, "successful_calls": 6, "failed_calls": 3, "rows_processed": 4,
                "rows_skipped": 3, "invalid_records": 2, "duplicates_removed": 1, "silver_rows": 4, "gold_rows": 2}
    assert {k: main[k] for k in expected} == expected
    assert main["rows_processed"] + main["invalid_records"] + main["duplicates_removed"] == 7
    assert main["api_summary"]["openmeteo"] == {"success": 2, "failed": 1}
    assert main["missing_values"] == {"nh3": 1, "no": 1}
    assert main["failed_requests"] == quality["failed_requests"] == {"count": 3, "path": f"{base}/reports/{run}/failed_requests"}
    listed = [json.loads(x) for f in Path(main["failed_requests"]["path"]).glob("*.json") for x in f.read_text().splitlines()]
    assert len(listed) == 3 and all(x["error"] for x in listed)
    assert len(main) == 16 and len(metrics) == 9 and len(quality) == 4
    assert main["drift"]["drift_detected"] is False and main["drift"]["features"] == {}
    assert published.exit_code == 1


def test_publishing_twice_changes_nothing(spark, live):
    base, landing, _ = live
    plain, versioned = [f"{base}/tables/raw_records", f"{base}/latest/raw"], f"{base}/tables/daily_features"
    stored = lambda: [sorted(map(str, df.collect())) for df in (*map(spark.read.parquet, plain), read_features(spark, versioned))]
    before = stored()
    run_live(spark, landing, cities(spark, CITIES), base, RUN)
    assert stored() == before
    assert len(before[0]) == 9 and len(before[2]) == 2


def test_later_run_wins_and_drift_is_compared(spark, live):
    base, _, _ = live
    later = Run("20240102_090000_test", datetime(2024, 1, 2, 9, tzinfo=timezone.utc))
    warm = land(f"{base}/landing2", [call(0, "openweather", "Alder", ow_live(temp=30.0))])
    run_live(spark, warm, cities(spark, CITIES), base, later, drift_against=RUN.run_id)
    rows = {r.city: r for r in read_features(spark, f"{base}/tables/daily_features").collect()}
    assert rows["Alder"].temperature == 30.0 and rows["Alder"].run_id == later.run_id and rows["Birch"].temperature == 12.0
    got = report(base, "drift", f"run_id={later.run_id}")
    assert got["drift_detected"] and got["comparison"] == RUN.run_id and got["features"]["temperature"]["previous_mean"] == 16.0
    # An older run does not replace newer rows.
    older = Run("20240102_070000_test", datetime(2024, 1, 2, 7, tzinfo=timezone.utc))
    run_live(spark, warm, cities(spark, CITIES), base, older)
    assert {r.city: r.run_id for r in read_features(spark, f"{base}/tables/daily_features").collect()}["Alder"] == later.run_id


def test_backfill(spark, tmp_path):
    landing = land(tmp_path / "landing", LIVE + PAST)
    published = run_backfill(spark, landing, cities(spark, CITIES), str(tmp_path / "out"), date(2024, 1, 1), date(2024, 1, 2), RUN)
    gold = {(r.city, r.data_date.isoformat()): r for r in read_snapshot(spark, str(tmp_path / "out"), "gold", RUN.run_id).collect()}
    assert sorted(gold) == [("Alder", "2024-01-01"), ("Birch", "2024-01-01"), ("Birch", "2024-01-02")]
    alder = gold["Alder", "2024-01-01"]
    assert (alder.temperature, alder.aqi, alder.timestamp.isoformat()) == (11.5, 2, "2024-01-01T10:00:00")
    assert gold["Birch", "2024-01-02"].temperature == 1.75 and gold["Birch", "2024-01-02"].aqi == 2
    assert published.exit_code == 0 and published.summary.first().total_api_calls == 4
    assert "drift" not in report(tmp_path / "out", f"run_id={RUN.run_id}", "pipeline")


def test_empty_landing(spark, tmp_path):
    landing = land(tmp_path / "landing", PAST)
    published = run_live(spark, landing, cities(spark, CITIES), str(tmp_path / "out"), RUN)
    s = published.summary.first()
    assert (s.total_api_calls, s.gold_rows, s.failed_requests["count"], published.exit_code) == (0, 0, 0, 0)


@pytest.mark.parametrize("start, end", [
    (date(2024, 1, 2), date(2024, 1, 1)), (date(2022, 12, 31), date(2024, 1, 1)), (None, date(2024, 1, 1)), (date(2024, 1, 1), None),
])
def test_window_checks(start, end):
    with pytest.raises(ValueError):
        check_window(start, end)


def test_window_accepts(spark):
    check_window(date(2023, 1, 1), date(2023, 1, 1))
    check_window(None, None)


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("x", None, ["a"])], "b string, a int, c array<string>")
    write_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["a,b,c", ',x,"[""a""]"']


def test_more_than_a_thousand_failures(spark, tmp_path):
    landing = land(tmp_path / "landing", [call(k, f"other{k}", "Alder", {}) for k in range(1200)])
    published = run_live(spark, landing, cities(spark, CITIES), str(tmp_path / "out"), RUN)
    main = report(tmp_path / "out", f"run_id={RUN.run_id}", "pipeline")
    assert main["failed_requests"]["count"] == 1200 and main["api_summary"] == {"unknown": {"success": 0, "failed": 1200}}
    assert spark.read.json(main["failed_requests"]["path"]).count() == 1200 and published.failed_calls == 1200


def test_merge_keeps_a_partition_without_a_value(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, d string, v int"
    last = lambda old, new: merge_latest(old, new, ["k", "d"], "v")
    VersionedTable(spark, path, "d").merge(spark.createDataFrame([("a", None, 1), ("b", "d1", 1)], schema), last)
    VersionedTable(spark, path, "d").merge(spark.createDataFrame([("z", None, 1), ("a", None, 2)], schema), last)
    assert sorted(map(tuple, read_versioned(spark, path, "d").select("k", "d", "v").collect()), key=str) == [("a", None, 2), ("b", "d1", 1), ("z", None, 1)]


def test_stream_equals_batch(spark, tmp_path):
    """Four files in four micro-batches: the first call of a day arrives late, a rejected earlier duplicate hides the only accepted
    row of its day, and one day has many records."""
    base, landing = str(tmp_path / "stream"), tmp_path / "landing"
    past = PAST[:4] + [call(9, "openweather", "Birch", ow_day(), "2024-01-01")]
    # The same raw key: what differs between them is out of range in the earlier one.
    hidden = [call(21, "openmeteo", "Alder", om_day(), "2024-01-03"), call(20, "openmeteo", "Alder", om_day(bad=True), "2024-01-03")]
    many = [call(100 + k, "openweather", "Birch", ow_day(second=k), "2024-01-04") for k in range(60)]
    for name, rows in (("a", [*past[1:3], hidden[0], *many[:30]]), ("b", [past[0], past[3]]), ("c", [past[4], past[1], hidden[1]]), ("d", many[30:])):
        land(landing, rows, f"{name}.json")
        query = ingest(spark, str(landing), cities(spark, CITIES), base, f"{base}/checkpoint", 1)
        query.awaitTermination()
    batch = run_backfill(spark, str(landing), cities(spark, CITIES), str(tmp_path / "batch"), date(2024, 1, 1), date(2024, 1, 4), RUN)
    columns = ["city", "data_date", "temperature", "aqi", "rain", "source", "timestamp", "lineage_records"]
    expected = read_snapshot(spark, batch.base, "gold", RUN.run_id).select(*columns).collect()
    got = spark.read.parquet(f"{base}/stream/gold").select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str) and len(got) == 4
    assert date(2024, 1, 3) not in {r.data_date for r in got} and max(r.lineage_records for r in got) == 60
    lineage = [sorted(map(tuple, df.select("city", "data_date", "ord", "source").collect())) for df in (
        spark.read.parquet(f"{base}/stream/lineage"), read_snapshot(spark, batch.base, "lineage", RUN.run_id))]
    assert lineage[0] == lineage[1] and len(lineage[0]) == sum(r.lineage_records for r in got)
    features = read_features(spark, f"{base}/tables/daily_features")
    assert sorted((r.city, str(r.data_date), r.temperature) for r in features.collect()) == sorted(
        (r.city, str(r.data_date), r.temperature) for r in got)
    raw = spark.read.parquet(f"{base}/tables/raw_records")
    assert raw.count() == 68 and raw.select("record_key").distinct().count() == 68


def test_partitioned_landing(spark, tmp_path):
    """A run reads only its folders, and an unreadable line belongs to the folder it landed in."""
    flat, folders = str(tmp_path / "flat"), str(tmp_path / "folders")
    land(flat, LIVE + PAST)
    write_landed(read_landed(spark, flat).drop("landed_run", "malformed"), folders, "first")
    write_landed(read_landed(spark, flat).drop("landed_run", "malformed").filter("ord = 0"), folders, "second")
    (tmp_path / "folders/landed_run=first/data_date=2024-01-01/source=openmeteo/cut.json").write_text("{broken\n")
    wanted = F.col("data_date").between(date(2024, 1, 1), date(2024, 1, 1)) & F.col("source").isin("openmeteo", "openweather")
    rows = of_window(of_run(read_landed(spark, folders), "first"), wanted)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = text[text.index("PartitionFilters") : text.index("PushedFilters")]
    assert all(x in filters for x in ("landed_run", "data_date", "source"))
    assert sorted(str(r.ord) for r in rows.select("ord").collect()) == ["10", "11", "12", "None"]
    published = run_backfill(spark, folders, cities(spark, CITIES), str(tmp_path / "out"), date(2024, 1, 1), date(2024, 1, 1), RUN, "first")
    assert published.summary.first().total_api_calls == 4 and published.failed_calls == 1
    other = run_backfill(spark, folders, cities(spark, CITIES), str(tmp_path / "out2"), date(2024, 1, 2), date(2024, 1, 2), RUN, "first")
    assert other.summary.first().total_api_calls == 1 and other.failed_calls == 0
    live = run_live(spark, folders, cities(spark, CITIES), str(tmp_path / "live"), RUN, landed_run="second")
    assert live.summary.first().total_api_calls == 1
