"""Heavy rows are dealt by their number, and payload checks read values instead of describing whole documents."""

import datetime

import pytest
from pyspark.sql import functions as F

from hazeline.functions import payload as J
from hazeline.plans import stand_ins
from hazeline.plans.stand_ins import RUN
from hazeline.sources import openweather
from hazeline.sources.landed import READERS, to_calls


def test_few_large_row_groups_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stand_ins, "ROWS_OF_A_TASK", 100)
    at = datetime.datetime(2024, 1, 1)
    rows = spark.range(6000).select(
        F.col("id").alias("event_id"), F.lit(at).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    landed = stand_ins.landed(spark, str(tmp_path), "openweather", True)
    sizes = [r[1] for r in landed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 300


CASES = {
    '{"list": [{"main": {"temp": 1}}, {"wind": {"deg": null}}, null, 5]}': None,
    '{"list": [{"main": {"temp": "7"}}]}': None,
    '{"list": [{"main": {"temp": "warm"}}]}': "failed",
    '{"list": [{"main": {"temp": {"x": 1}}}]}': "failed",
    '{"list": [{"main": null}]}': "failed",
    '{"list": [{"wind": [1]}]}': "failed",
    '{"list": [{"rain": {"1h": "wet"}}]}': "failed",
    '{"list": [{"rain": 5}]}': "failed",
}


@pytest.fixture(scope="module")
def days(spark):
    air = '{"list": [{"main": {"aqi": 1}, "components": {"co": 2}}]}'
    rows = [(k, "openweather", ["e"], "C", datetime.date(2024, 1, 1), f'{{"weather": {w}, "air_quality": {air}}}', [], 1.0) for k, w in enumerate(CASES)]
    schema = "ord bigint, source string, endpoint array<string>, city string, data_date date, payload string, errors array<string>, response_time_seconds double"
    return to_calls(spark.createDataFrame(rows, schema), RUN, {"openweather": READERS["openweather"]})


def test_items_with_gaps_are_judged_value_by_value(days):
    got = [r.status for r in days.select("ord", "status").orderBy("ord").collect()]
    assert got == [expected or "success" for expected in CASES.values()]


def test_items_are_not_described(spark):
    """The schema text of an item costs far more than the value looked for."""
    p = F.col("p")
    broken = openweather.history(p, {n: F.try_variant_get(p, *d) for n, d in openweather.DOCUMENTS.items()}, {}, F.lit("2024-01-01"))[1]
    # What is left looks at a missing pollution list, once a call.
    assert str(broken).count("schema_of_variant") <= 6


@pytest.mark.parametrize(("text", "expected"), [("[0]", ("0", False)), ("[]", (None, False)), ('"ab"', ("a", False)), ("7", (None, True)), ("0.0", (None, False)), ('"0"', ("0", False)), ('{"x": 1}', (None, True)), ("{}", (None, False))])
def test_first_of(spark, text, expected):
    first, none = J.first_of(F.try_parse_json("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(first.cast("string"), none).first()) == expected
