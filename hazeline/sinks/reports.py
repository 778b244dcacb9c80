"""Run reports: one JSON row each, built from small aggregates of written tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.operators.bronze import SUCCESS
from hazeline.operators.drift import drift_detected
from hazeline.operators.metrics import api_summary, counters_of, known_source, missing_values

# The keys of the reports.
METRICS_KEYS = [
    "run_id", "total_api_calls", "successful_calls", "failed_calls", "rows_processed", "rows_skipped",
    "invalid_records", "duplicates_removed", "execution_time_seconds",
]
PIPELINE_KEYS = [
    "run_id", "cities_processed", "total_api_calls", "successful_calls", "failed_calls", "rows_processed",
    "rows_skipped", "invalid_records", "duplicates_removed", "silver_rows", "gold_rows", "execution_time_seconds",
    "failed_requests", "api_summary", "missing_values",
]
QUALITY_KEYS = ["run_id", "missing_values", "api_summary", "failed_requests"]


def _as_map(df: DataFrame, key: str, value) -> DataFrame:
    entry = F.collect_list(F.struct(F.col(key), value))
    return df.agg(F.map_from_entries(F.array_sort(entry)).alias("m"))


def summary(
    counters: DataFrame, calls: DataFrame, gold: DataFrame, run_id: str, cities_processed: int, seconds: float, failures: str = ""
) -> DataFrame:
    """The run summary as one row: counters, per-source results, missing values, failed calls.

    The maps have one entry per provider and per monitored field. ``failed_requests`` is the number of failed calls and the
    path of their table, which lists all of them.
    """
    per_source = _as_map(api_summary(calls.withColumn("source", known_source(F.col("source")))), "source", F.struct("success", "failed"))
    missing = _as_map(missing_values(gold), "field", F.col("missing"))
    failed = calls.agg(F.count_if(F.col("status") != SUCCESS).alias("n"))
    # Every frame below is a single row.
    return counters.select(
        "*",
        F.lit(run_id).alias("run_id"),
        F.lit(cities_processed).alias("cities_processed"),
        F.lit(seconds).alias("execution_time_seconds"),
        F.struct(failed.scalar().alias("count"), F.lit(failures).alias("path")).alias("failed_requests"),
        per_source.scalar().alias("api_summary"),
        missing.scalar().alias("missing_values"),
    )


def observed_summary(
    spark: SparkSession, seen: Mapping[str, int], run_id: str, cities_processed: int, seconds: float, failures: str = ""
) -> DataFrame:
    """The same row as ``summary`` from counters observed while the layers were written; reads no layer."""
    counters = counters_of(seen)
    sources = {k.partition(":")[2]: None for k, n in seen.items() if k.startswith("calls:") and n}
    per_source = {name: (seen[f"success:{name}"], seen[f"failed:{name}"]) for name in sorted(sources)}
    missing = {k.partition(":")[2]: n for k, n in sorted(seen.items()) if k.startswith("missing:") and n}
    schema = (
        ", ".join(f"{c} bigint" for c in counters) + ", run_id string, cities_processed int, execution_time_seconds double, "
        "failed_requests struct<count:bigint,path:string>, api_summary map<string,struct<success:bigint,failed:bigint>>, missing_values map<string,bigint>"
    )
    row = (*counters.values(), run_id, cities_processed, seconds, (seen["failed_calls"], failures), per_source, missing)
    return spark.createDataFrame([row], schema)


def pipeline_report(run_summary: DataFrame, drift_row: DataFrame | None = None) -> DataFrame:
    report = run_summary.select(*PIPELINE_KEYS)
    if drift_row is None:
        return report
    return report.withColumn("drift", drift_row.select(F.struct("*")).scalar())


def metrics_report(run_summary: DataFrame) -> DataFrame:
    return run_summary.select(*METRICS_KEYS)


def quality_report(run_summary: DataFrame) -> DataFrame:
    return run_summary.select(*QUALITY_KEYS)


def drift_report(features: DataFrame, run_id: str, comparison: str | None = None) -> DataFrame:
    """One row: run, comparison, drift flag and the compared features (one entry per threshold at most)."""
    figures = F.struct(*[F.col(c) for c in features.columns if c != "feature"])
    per_feature = _as_map(features, "feature", figures)
    flag = drift_detected(features).select("drift_detected")
    return flag.select(
        F.lit(run_id).alias("run_id"),
        F.lit(comparison).cast("string").alias("comparison"),
        F.lit(0.0).alias("execution_time"),
        "drift_detected",
        per_feature.scalar().alias("features"),
    )


def write_report(row: DataFrame, path: str) -> None:
    """One JSON file; the frame is a single row."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
