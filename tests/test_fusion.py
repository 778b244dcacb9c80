"""Fusion, lineage, upserts, statistics and drift, with hot groups."""

import random
from collections import defaultdict
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.operators.drift import drift, drift_all_statistics, drift_detected
from hazeline.operators.fuse import fuse, gather, lineage_lists, lineage_rows
from hazeline.operators.statistics import column_statistics
from hazeline.operators.upsert import merge_by_key, merge_latest

SILVER = "ord bigint, city string, record_date date, data_date date, source string, endpoint array<string>, status string, temperature double, raw_payload string"
DAY = date(2024, 1, 1)


def silver(spark, rows):
    return spark.createDataFrame([(o, c, DAY, None, s, [s], "success", t, "{}") for o, c, s, t in rows], SILVER)


def test_first_record_wins_whole(spark):
    df = silver(spark, [(2, "A", "openmeteo", 21.0), (1, "A", "openweather", None), (3, "B", "aqicn", 5.0)])
    rows = {r.city: r for r in fuse(df).collect()}
    a = rows["A"]
    assert (a.temperature, a.source, a.status, a.endpoint, a.data_date) == (None, "merged", "merged", ["merged"], DAY)
    assert a.lineage_records == 2 and rows["B"].temperature == 5.0 and rows["B"].lineage_records == 1
    assert "raw_payload" in fuse(df).columns and "raw_payload" not in fuse(df, include_payload=False).columns
    long = sorted((r.city, r.ord, r.source_api, r.data_date, r.source, r.source_record.temperature) for r in lineage_rows(df, ["temperature"]).collect())
    assert long == [("A", 1, "merged", DAY, "openweather", None), ("A", 2, "merged", DAY, "openmeteo", 21.0), ("B", 3, "merged", DAY, "aqicn", 5.0)]


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_hot_group_stays_whole(spark, step):
    """One group of 3,000 records, its arrival order dense or sparse: none is missing in count, rows, lists or pages."""
    rows = [(i * step, "HOT" if i % 3 else f"C{i % 50}", "ab"[i % 2], float(i)) for i in range(4500)]
    random.Random(3).shuffle(rows)
    df = silver(spark, rows)
    expected = defaultdict(list)
    for _, c, _, t in sorted(rows):
        expected[c].append(t)
    gold = {r.city: r for r in fuse(df).collect()}
    assert {c: r.lineage_records for c, r in gold.items()} == {c: len(v) for c, v in expected.items()} and gold["HOT"].temperature == 1.0
    assert lineage_rows(df, ["temperature"]).count() == 4500 and len(expected["HOT"]) == 3000
    assert {r.city: r.temperature for r in lineage_lists(df, ["temperature"]).collect()} == expected
    pages = defaultdict(list)
    for r in sorted(gather(df, ["temperature"], limit=25).collect(), key=lambda r: (r.city, r.slice)):
        assert len(r["items"]) <= 25 or r.slice == 0
        pages[r.city] += [x.temperature for x in r["items"]]
    assert pages == expected


@pytest.mark.parametrize("partitions", [1, 7])
def test_fusion_does_not_depend_on_row_order(spark, partitions):
    rows = [(i, f"C{i % 5}", "s", float(i)) for i in range(50)]
    random.Random(1).shuffle(rows)
    got = {r.city: r.temperature for r in fuse(silver(spark, rows).repartition(partitions)).collect()}
    assert got == {f"C{i}": float(i) for i in range(5)}


def test_merge_by_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    incoming = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N"), (3, "C")], "k int, v string")
    assert sorted(merge_by_key(target, incoming, ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "B"), (3, "C"), (None, "N")], key=str)


def test_merge_latest(spark):
    old = spark.createDataFrame([("A", 2, "old"), ("B", 1, "old"), ("C", 1, "old")], "k string, retrieved_at int, v string")
    new = spark.createDataFrame([("A", 1, "new"), ("B", 1, "new"), ("D", 1, "new")], "k string, retrieved_at int, v string")
    assert {r.k: r.v for r in merge_latest(old, new, ["k"]).collect()} == {"A": "old", "B": "new", "C": "old", "D": "new"}


FRAMES = [
    [1.0, 2.0, None, 4.0, float("nan")],
    [5.0],
    [None, None],
    [3.0] * 400 + [1.0, 9.0, 2.5],
    [random.Random(5).uniform(-1e6, 1e6) for _ in range(999)],
    [random.Random(6).choice([1e300, -1e300, 0.0, 1e-300, 7.0]) for _ in range(500)],
    [float(i // 2) for i in range(1000)],
    [float("inf"), 1.0, 2.0, 3.0],
]


@pytest.mark.parametrize("i", range(len(FRAMES)))
def test_statistics_equal_pandas(spark, i):
    data = FRAMES[i]
    df = spark.createDataFrame([(v,) for v in data], "x double")
    got, s = column_statistics(df, ["x"]).first(), pd.Series(data, dtype="float64")

    def same(a, b):
        return (a is None and pd.isna(b)) or a == b or (a is not None and (pd.isna(b) and a != a or abs(a - b) <= 1e-9 * max(1.0, abs(b))))

    assert same(got.median, s.median()) and got.unique_values == s.nunique()
    assert same(got.minimum, s.min()) and same(got.maximum, s.max())
    if i not in (5, 7):
        assert same(got["mean"], s.mean()) and same(got.standard_deviation, s.std())
    assert got.missing_count == s.isna().sum() and same(got.missing_percentage, s.isna().mean() * 100)
    assert got.record_count == len(data)


def frame(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))


def test_drift(spark):
    previous = frame(spark, temperature=[19.0, 21.0], aqi=[0.0, 0.0], humidity=[50.0, 50.0])
    current = frame(spark, temperature=[21.0, 21.0], aqi=[3.0, 5.0], humidity=[51.0, None])
    rows = {r.feature: r for r in drift(current, previous).collect()}
    assert rows["temperature"].percentage == 5.0 and rows["temperature"].difference == 1.0
    assert rows["aqi"].percentage is None and rows["aqi"].difference == 4.0
    assert rows["humidity"].percentage == 2.0 and rows["humidity"].current_missing_count == 1
    assert tuple(drift_detected(drift(current, previous)).first()) == (True, 3)
    assert tuple(drift_detected(drift(current, previous, {"temperature": 5.1})).first()) == (False, 1)


def test_drift_without_baseline(spark):
    current = frame(spark, temperature=[21.0], aqi=[3.0])
    for previous in (None, current.limit(0), frame(spark, other=[1.0])):
        assert tuple(drift_detected(drift(current, previous)).first()) == (False, 0)
    assert drift(current, frame(spark, aqi=[3.0])).select("feature").collect() == [("aqi",)]


def test_drift_of_all_statistics(spark):
    current = frame(spark, temperature=[30.0, 32.0], no=[0.0, 0.0])
    same = {(r.feature, r.statistic): r for r in drift_all_statistics(current, current).collect()}
    assert len(same) == 18 and all(r.difference == 0 for r in same.values())
    assert same["temperature", "mean"].percentage == 0.0 and same["no", "mean"].percentage is None
    assert same["temperature", "missing_count"].percentage is None and same["temperature", "record_count"].current == 2.0
    first = drift_all_statistics(current).collect()
    assert len(first) == 18 and all(r.previous is None and r.difference is None and not r.drift_detected for r in first)


def test_thresholds_of_any_column(spark):
    rows = drift(frame(spark, o3=[11.0]), frame(spark, o3=[10.0]), {"o3": 9.5}).collect()
    assert [(r.feature, r.threshold, round(r.percentage, 6)) for r in rows] == [("o3", 9.5, 10.0)]
