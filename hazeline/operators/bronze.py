"""Calls: outcome status, raw records, failed-call listing and call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.contracts import BRONZE_COLUMNS, PIPELINE_VERSION
from hazeline.functions import times as D
from hazeline.operators.standardize import Run, api_version

SUCCESS, PARTIAL, FAILED, UNKNOWN = "success", "partial", "failed", "unknown"


def call_status(problem: Column, errors: Column) -> Column:
    """failed when normalization broke, partial when a request did, success otherwise (also without requests)."""
    return F.when(problem.isNotNull(), FAILED).when(F.size(errors) > 0, PARTIAL).otherwise(SUCCESS)


def call_error(problem: Column, errors: Column) -> Column:
    return F.coalesce(problem, F.when(F.size(errors) > 0, F.array_join(errors, "; ")))


def bronze(calls: DataFrame, run: Run) -> DataFrame:
    """Raw records: one per call, none dropped. Calls that could not be read get the ``unknown`` names."""
    day = next(f.dataType.typeName() for f in calls.schema.fields if f.name == "data_date")
    values = {
        "run_id": F.lit(run.run_id),
        "source": F.coalesce("source", F.lit(UNKNOWN)),
        "city": F.coalesce("city", F.lit(UNKNOWN)),
        "status": F.coalesce("status", F.lit(FAILED)),
        "pipeline_version": F.lit(PIPELINE_VERSION),
        "api_version": api_version(F.col("source")),
        "retrieved_at": run.instant,
        "response_time_ms": (F.coalesce("response_time_seconds", F.lit(0.0)) * 1000).try_cast("int"),
        "response_time_seconds": F.coalesce("response_time_seconds", F.lit(0.0)),
        "data_date": D.iso_day(F.col("data_date")) if day != "string" else F.col("data_date"),
    }
    return calls.select(*[values.get(c, F.col(c)).alias(c) for c in BRONZE_COLUMNS])


def failed_requests(calls: DataFrame) -> DataFrame:
    """Calls that were no full success (partial ones included) with a reason."""
    reason = F.when(F.col("error") != "", F.col("error"))
    return calls.filter(F.col("status") != SUCCESS).select(
        "source", "city", F.coalesce(reason, F.lit("Unknown error")).alias("error")
    )


def call_log(calls: DataFrame) -> DataFrame:
    """One log line per call."""
    reason = F.when(F.col("error") != "", F.concat(F.lit("Reason="), F.col("error")))
    milliseconds = (F.col("response_time_seconds") * 1000).try_cast("bigint")
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("City="), F.col("city")),
        F.concat(F.lit("API="), F.col("source")),
        F.concat(F.lit("Status="), F.upper("status")),
        F.concat(F.lit("ResponseTime="), milliseconds.cast("string"), F.lit("ms")),
        reason,
    )
    order = ["ord"] if "ord" in calls.columns else []
    return calls.select(*order, line.alias("line"))
