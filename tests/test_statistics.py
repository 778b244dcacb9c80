"""Statistics from stored value counts equal those from rows; merged parts equal the whole."""

import math
import random

import pytest

from hazeline.operators.drift import drift, drift_of_counts
from hazeline.operators.statistics import STATISTICS, column_statistics, merged_counts, numeric_columns, statistics_of, value_counts


def rows_of(kind):
    pick = random.Random(kind)
    if kind == "mixed":
        return [(pick.gauss(0, 5) if k % 7 else None, float(k % 3), k, "x") for k in range(501)]
    if kind == "outliers":  # the middle is far inside one zone of the first round
        return [(1e6 if k == 0 else -1e6 if k == 1 else k / 1000, math.nan if k % 2 else 1.0, None, "x") for k in range(1000)]
    if kind == "infinite":
        return [(float("inf"), -1.5, 3, "x"), (1.0, -0.0, 4, "x"), (2.0, 0.0, 4, "x")]
    return [(7.25, None, 1, "x")] if kind == "one" else []


@pytest.mark.parametrize("kind", ["mixed", "outliers", "one", "none"])
def test_counts_give_the_same_statistics(spark, kind):
    df = spark.createDataFrame(rows_of(kind), "a double, b double, c int, t string")
    assert numeric_columns(df) == ["a", "b", "c"]
    parts = df.randomSplit([0.3, 0.7], 1)
    got = {r.feature: r for r in statistics_of(merged_counts(*[value_counts(p, ["a", "b", "c"]) for p in parts])).collect()}
    expected = {r.feature: r for r in column_statistics(df, ["a", "b", "c"]).collect()} if kind != "none" else {}
    assert got.keys() == expected.keys()
    for feature, row in expected.items():
        for s in STATISTICS:
            assert got[feature][s] == (row[s] if row[s] is None else pytest.approx(row[s], rel=1e-9, abs=1e-9)), (feature, s)


def test_infinite_values_have_a_median(spark):
    df = spark.createDataFrame(rows_of("infinite"), "a double, b double, c int, t string")
    got = {r.feature: r for r in statistics_of(value_counts(df, ["a", "b", "c"])).collect()}
    assert got["a"].median == 2.0 and got["a"].maximum == float("inf") and got["b"].unique_values == 2 and got["c"].median == 4.0


def test_drift_of_counts(spark):
    old, new = (spark.createDataFrame([(x * f, 1.0 * k) for k, x in enumerate([1.0, 2.0, 4.0])], "temperature double, only double") for f in (1, 2))
    counts = [value_counts(df, numeric_columns(df)) for df in (new, old)]
    limits = {"temperature": 5.0, "absent": 1.0}
    got, expected = (df.collect() for df in (drift_of_counts(*counts, limits), drift(new, old, limits)))
    assert len(got) == len(expected) == 1 and got[0].feature == expected[0].feature
    assert list(got[0])[1:] == pytest.approx(list(expected[0])[1:], rel=1e-12)
    none = drift_of_counts(counts[0], None, limits)
    assert none.count() == 0 and none.columns == drift(new, old, limits).columns and drift_of_counts(counts[0], counts[1].limit(0), limits).count() == 0
