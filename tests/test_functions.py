"""Column functions: fixed cases and comparison with Python's own arithmetic."""

import random
from datetime import date, datetime
from statistics import mean

import pytest
from pyspark.sql import functions as F

from hazeline.functions import numbers as N
from hazeline.functions import payload as J
from hazeline.functions import text as X
from hazeline.functions import times as D
from hazeline.functions.keys import record_key


def values(spark, cases, make, type_="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {type_}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x")).alias("r")).collect()]


def test_null_tokens(spark):
    cases = [" n/a ", "N/A", "", " \t ", " x\n", "-", None]
    assert values(spark, cases, X.null_token) == [None, None, None, None, "x", "-", None]


def test_city_keys(spark):
    cases = ["Khairpur Mir's", " a--b ", "São Paulo"]
    assert values(spark, cases, X.setting_key) == ["KHAIRPUR_MIR_S", "A_B", "S_O_PAULO"]
    assert values(spark, cases, X.city_key) == ["KHAIRPUR_MIR_S", "A__B", "SÃO_PAULO"]


def test_number_text(spark):
    cases = ["12", " 12.5 ", "1e3", "1_000", "-", "1d", "0x1", "", "inf", "nan"]
    got = values(spark, cases, N.number_from_text)
    assert got[:9] == [12.0, 12.5, 1000.0, 1000.0, None, None, None, None, float("inf")]
    assert got[9] != got[9]


def test_whole_text(spark):
    cases = ["12", "12.0", "12.5", "12.", "1e3", "-", "+5", "1_000"]
    assert values(spark, cases, N.whole_from_text) == [12, 12, None, None, None, None, 5, 1000]


def test_half_even_and_falsy(spark):
    assert values(spark, [2.5, 3.5, -0.4, -3.0], lambda c: N.half_even(c).cast("bigint"), "double") == [2, 4, 0, -3]
    pairs = [(0.0, 2.0, 2.0), (0.0, None, None), (1.0, 2.0, 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a double, b double")
    assert [r[0] for r in df.coalesce(1).select(N.falsy_or(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_milliseconds(spark):
    assert values(spark, [0.2579, None, 0.0], N.whole_milliseconds, "double") == [257, 0, 0]


def test_means_equal_exact_arithmetic(spark):
    rng = random.Random(7)
    cases = [[rng.choice([None, round(rng.uniform(-50, 50), rng.choice([2, 4, 5])), rng.randint(-99, 99) / 32])
              for _ in range(rng.randint(0, 24))] for _ in range(3000)]
    cases += [[1.00005], [0.03125], [1.0, None, 2.5], [], [None], [1e12, 3.0], [0.1, 0.2]]
    kept = [[v for v in c if v is not None] for c in cases]
    expected = [round(mean(k), 4) if k else None for k in kept]
    assert values(spark, cases, N.array_mean, "array<double>") == expected
    df = spark.createDataFrame([(i, v) for i, c in enumerate(cases) for v in (c or [None])], "i int, v double")
    got = dict(df.groupBy("i").agg(N.group_mean(F.col("v")).alias("m")).collect())
    assert [got[i] for i in range(len(cases))] == expected


def test_instants(spark):
    cases = ["2024-01-01", "2024-01-01T10:00", "2024-01-01 10:00:00+05:00", "1704067200", "1704067200000", "2024", "someday",
             "2024-01-01T10", "2024-13-01"]
    got = values(spark, cases, lambda c: F.date_format(D.instant_from_text(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-01 00:00:00", "2024-01-01 10:00:00", "2024-01-01 05:00:00", "2024-01-01 00:00:00",
                   "2024-01-01 00:00:00", "1970-01-01 00:33:44", None, None, None]


def test_days(spark):
    cases = ["2024-01-02", "2024-01-02T00:00:00", "2024-01-02T01:00:00", "1704067200", "2024"]
    assert values(spark, cases, D.day_from_text) == [date(2024, 1, 2), date(2024, 1, 2), None, date(2024, 1, 1), None]


def test_own_offset_day(spark):
    got = values(spark, ["2024-01-02T01:00:00+05:00"], lambda c: D.own_offset_day(c, D.instant_from_text(c)))
    assert got == [date(2024, 1, 2)]


def test_epoch_window(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),)], "d date")
    row = df.select(D.day_start_epoch(F.col("d")), D.day_end_epoch(F.col("d"))).first()
    start = int(datetime.fromisoformat("2024-01-01T00:00:00+00:00").timestamp())
    assert tuple(row) == (start, start + 86399)


def test_documents(spark):
    cases = ['{"a":1}', " [1] ", "oops", "5", "null", " n/a ", '"text"']
    assert values(spark, cases, J.document_text) == ['{"a":1}', "[1]", None, "5", None, None, '"text"']
    assert values(spark, cases, lambda c: J.is_document(J.document_text(c))) == [True, True, None, False, None, None, False]


@pytest.mark.parametrize("body, expected", [
    ("0", False), ('""', False), ("{}", False), ("[]", False), ("null", False), ("false", False), ("0.0", False),
    ("1", True), ('"0"', True), ('{"a":0}', True), ("true", True), ("[0]", True),
])
def test_truthy(spark, body, expected):
    assert values(spark, [body], lambda c: J.truthy(F.try_parse_json(c))) == [expected]


def test_record_key(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "x", None), (1, None, "x")], "b int, a string, c string")
    got = [r[0] for r in df.coalesce(1).select(record_key(df.columns)).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 40
    assert [r[0] for r in df.coalesce(1).select(record_key(["c", "a", "b"])).collect()] == got
