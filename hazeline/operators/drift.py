"""Drift of gold columns between two datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.contracts import DRIFT_THRESHOLDS
from hazeline.operators.statistics import STATISTICS, column_statistics, number, statistics_of

# Thresholds of the older report form.
ALL_STATISTICS_THRESHOLDS = {"temperature": 5.0} | dict.fromkeys(
    ["humidity", "pressure", "wind_speed", "aqi", "pm25", "pm10", "co", "no", "no2", "so2", "o3", "nh3"], 10.0
)
_SIDE = "_side"
_SHORT = {"minimum": "min", "maximum": "max", "standard_deviation": "std"}
_NINE_EXCEPT_COUNT = [s for s in STATISTICS if s != "record_count"]


def _threshold(thresholds: Mapping[str, float]) -> Column:
    pairs = F.create_map(*[x for f, t in thresholds.items() for x in (F.lit(f), F.lit(float(t)))])
    return F.try_element_at(pairs, F.col("feature"))


def percentage(difference: Column, previous: Column) -> Column:
    """Absolute change in percent of the earlier value; null when that is zero or missing."""
    return F.when(previous != 0, F.abs(difference) / F.abs(previous) * 100)


def _paired(current: DataFrame, previous: DataFrame | None, thresholds: Mapping[str, float]) -> DataFrame | None:
    """Statistics of the features both datasets have, side by side. A dataset without rows has no features."""
    if previous is None:
        return None
    shared = [f for f in thresholds if f in current.columns and f in previous.columns]
    if not shared:
        return None
    return _by_feature(column_statistics(_tagged(current, previous, shared), shared, _SIDE), thresholds)


def _by_feature(both: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    # Two rows per monitored feature; a side without rows has none.
    sides = [F.max(F.when(F.col(_SIDE) == side, F.struct(*STATISTICS))).alias(side) for side in ("current", "previous")]
    paired = both.groupBy("feature").agg(*sides).filter("current IS NOT NULL AND previous IS NOT NULL")
    return paired.select(
        "feature", *[F.col(side)[s].alias(f"{side}_{s}") for side in ("current", "previous") for s in STATISTICS]
    ).withColumn("threshold", _threshold(thresholds))


def _tagged(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both datasets with their side, as numbers; NaN counts as missing."""
    parts = []
    for df, side in ((current, "current"), (previous, "previous")):
        parts.append(df.select(F.lit(side).alias(_SIDE), *[number(df, c).alias(c) for c in columns]))
    return parts[0].unionByName(parts[1])


def mean_drift(
    current: DataFrame, previous: DataFrame | None = None, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Of ``drift`` only what the flag needs: (feature, percentage, threshold), from one aggregate of means."""
    limits = thresholds or DRIFT_THRESHOLDS
    shared = [] if previous is None else [f for f in limits if f in current.columns and f in previous.columns]
    if not shared:
        return current.sparkSession.createDataFrame([], "feature string, percentage double, threshold double")
    means = _tagged(current, previous, shared).groupBy(_SIDE).agg(*[F.avg(f"`{c}`").alias(c) for c in shared])
    long = means.unpivot([F.col(_SIDE)], [F.col(f"`{c}`") for c in shared], "feature", "mean")
    sides = {side: F.max(F.when(F.col(_SIDE) == side, F.struct("mean"))) for side in ("current", "previous")}
    paired = long.groupBy("feature").agg(*[v.alias(k) for k, v in sides.items()]).filter("current IS NOT NULL AND previous IS NOT NULL")
    change = percentage(F.col("current.mean") - F.col("previous.mean"), F.col("previous.mean"))
    return paired.select("feature", change.alias("percentage"), _threshold(limits).alias("threshold"))


def drift_warnings(current: DataFrame, previous: DataFrame | None, thresholds: Mapping[str, float] | None = None) -> list[str]:
    """Notes of the older report form: nothing to compare with, and monitored columns that a side lacks."""
    if previous is None:
        return ["no earlier dataset to compare with"]
    limits = thresholds or ALL_STATISTICS_THRESHOLDS
    return [f"{side} dataset has no column {f}" for side, df in (("current", current), ("earlier", previous)) for f in limits if f not in df.columns]


_DRIFT_SCHEMA = (
    "feature string, "
    + ", ".join(
        f"{side}_{_SHORT.get(s, s)} {'bigint' if s in ('missing_count', 'unique_values') else 'double'}"
        for s in _NINE_EXCEPT_COUNT
        for side in ("current", "previous")
    )
    + ", difference double, percentage double, threshold double"
)


def drift(
    current: DataFrame, previous: DataFrame | None = None, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """One row per compared feature; no rows when there is nothing to compare with.

    ``thresholds`` maps any numeric column to a percentage and replaces the default set.
    """
    pairs = _paired(current, previous, thresholds or DRIFT_THRESHOLDS)
    if pairs is None:
        return current.sparkSession.createDataFrame([], _DRIFT_SCHEMA)
    return _changes(pairs)


def drift_of_counts(current: DataFrame, previous: DataFrame | None = None, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """``drift`` from the stored value counts of two datasets; no row of either is read."""
    limits = thresholds or DRIFT_THRESHOLDS
    if previous is None:
        return current.sparkSession.createDataFrame([], _DRIFT_SCHEMA)
    sides = [
        statistics_of(counts.filter(F.col("feature").isin(*limits))).withColumn(_SIDE, F.lit(side)) for counts, side in ((current, "current"), (previous, "previous"))
    ]
    return _changes(_by_feature(sides[0].unionByName(sides[1]), limits))


def _changes(pairs: DataFrame) -> DataFrame:
    difference = F.col("current_mean") - F.col("previous_mean")
    return pairs.select(
        "feature",
        *[F.col(f"{side}_{s}").alias(f"{side}_{_SHORT.get(s, s)}") for s in _NINE_EXCEPT_COUNT for side in ("current", "previous")],
        difference.alias("difference"),
        percentage(difference, F.col("previous_mean")).alias("percentage"),
        "threshold",
    )


def drifted(change: Column, threshold: Column) -> Column:
    """A feature drifts when its change reaches the threshold."""
    return F.coalesce(change >= threshold, F.lit(False))


def drift_detected(features: DataFrame) -> DataFrame:
    """One row: whether any feature drifted, and how many were compared."""
    return features.agg(
        F.coalesce(F.bool_or(drifted(F.col("percentage"), F.col("threshold"))), F.lit(False)).alias("drift_detected"),
        F.count(F.lit(1)).alias("features"),
    )


def drift_all_statistics(
    current: DataFrame, previous: DataFrame | None = None, thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Difference and percentage of every statistic, one row per (feature, statistic).

    This is the older report form, derived from its output. Without an earlier dataset the current figures remain
    and everything else is null.
    """
    limits = thresholds or ALL_STATISTICS_THRESHOLDS
    pairs = _paired(current, previous, limits)
    if pairs is None:
        now = column_statistics(current, [f for f in limits if f in current.columns])
        pairs = now.select(
            "feature",
            *[F.col(s).alias(f"current_{s}") for s in STATISTICS],
            *[F.lit(None).cast("double").alias(f"previous_{s}") for s in STATISTICS],
        ).withColumn("threshold", _threshold(limits))
    mean_change = percentage(F.col("current_mean") - F.col("previous_mean"), F.col("previous_mean"))
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(s).alias("statistic"),
            F.col(f"current_{s}").cast("double").alias("current"),
            F.col(f"previous_{s}").cast("double").alias("previous"),
        )
        for s in STATISTICS
    ]))
    long = pairs.select("feature", "threshold", drifted(mean_change, F.col("threshold")).alias("drift_detected"), rows)
    difference = F.col("current") - F.col("previous")
    return long.select(
        "feature", "statistic", "current", "previous", difference.alias("difference"),
        percentage(difference, F.col("previous")).alias("percentage"), "threshold", "drift_detected",
    )
