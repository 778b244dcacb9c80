"""Live runs and backfills: landed calls to bronze, silver, gold, counters, drift and published tables.

Every layer is written once and read back by the next one. That cuts lineage with plain tables: a lost executor
costs tasks of one stage and nothing is cached. Counters are observed while layers are written, and a manifest
keeps them, so that a run that died is resumed at the layer it was at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.contracts import MEASURES, SILVER_COLUMNS, SOURCES
from hazeline.operators.bronze import FAILED, bronze, call_log, failed_requests
from hazeline.operators.clean import clean
from hazeline.operators.drift import drift, drift_of_counts
from hazeline.operators.fuse import fuse, lineage_rows
from hazeline.operators.metrics import call_counters, gold_counters, record_counters
from hazeline.operators.standardize import Run, standardize
from hazeline.operators.statistics import numeric_columns, value_counts
from hazeline.operators.survivors import first_by_arrival
from hazeline.operators.validate import ERRORS, RECORD_DATE, check, with_record_date
from hazeline.session import prepare
from hazeline.sinks import reports, snapshots, tables
from hazeline.sinks.publish import Manifest
from hazeline.sources.landed import of_run, of_window, read_landed, to_calls, to_records
from hazeline.sources.spine import check_window

ACCEPTED = "accepted"
LAYERS = ("bronze", "checked", "silver", "quarantine", "gold", "lineage")
PARTITIONS = {"bronze": ("source",), "checked": (ACCEPTED,)}
#: Of a source record in lineage; its payload is in bronze.
LINEAGE_COLUMNS = [c for c in SILVER_COLUMNS if c not in ("raw_payload", "lineage")]


@dataclass(frozen=True)
class Published:
    """Where a run left its outputs, and its one-row summary."""

    run: Run
    base: str
    summary: DataFrame
    failed_calls: int

    @property
    def exit_code(self) -> int:
        """0 when every call was a full success."""
        return 0 if self.failed_calls == 0 else 1


def checked_records(records: DataFrame, run: Run) -> DataFrame:
    """Source records to checked silver rows: first by arrival, clean, day, stamp, validate. One exchange."""
    cleaned = clean(first_by_arrival(records), keep=("ord",))
    return check(standardize(with_record_date(cleaned), run), keep=("ord", RECORD_DATE))


def silver_of(checked: DataFrame) -> DataFrame:
    return checked.filter(ACCEPTED).select("ord", *SILVER_COLUMNS, RECORD_DATE)


def quarantine_of(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col(ACCEPTED))


def _written(planned: DataFrame, base: str, layer: str, run: Run) -> DataFrame:
    """The layer as stored. A layer without rows may leave no files; then an empty frame of the planned columns."""
    spark = planned.sparkSession
    stored = snapshots.read_snapshot(spark, base, layer, run.run_id)
    return spark.createDataFrame([], planned.schema) if stored is None else stored


def _accepted(checked: DataFrame) -> DataFrame:
    return checked.withColumn(ACCEPTED, F.col(ACCEPTED).cast("boolean"))


def publish_layers(manifest: Manifest, planned_raw: DataFrame, planned: DataFrame, base: str, run: Run) -> tuple[DataFrame, DataFrame]:
    """Ten steps from planned bronze and checked rows to published tables; returns bronze and gold as stored."""

    def layer(name: str, rows: DataFrame, counters: Mapping[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        manifest.step(name, rows, lambda df: snapshots.write_snapshot(df, base, name, run.run_id, by), counters, by)
        return _written(rows, base, name, run)

    raw = layer("bronze", planned_raw, call_counters(F.col("status") != FAILED), PARTITIONS["bronze"])
    # Both kinds come from one pass; silver and quarantine are layers of their own.
    checked = _accepted(layer("checked", planned.withColumn(ACCEPTED, F.size(ERRORS) == 0), record_counters(F.col(ACCEPTED)), PARTITIONS["checked"]))
    silver = layer("silver", silver_of(checked))
    layer("quarantine", quarantine_of(checked).drop(ACCEPTED))
    gold = layer("gold", fuse(silver), gold_counters(MEASURES))
    layer("statistics", value_counts(gold, numeric_columns(gold)))
    layer("lineage", lineage_rows(silver, LINEAGE_COLUMNS))
    manifest.step("latest", raw, lambda df: snapshots.write_latest(df, f"{base}/latest/raw"))
    manifest.action("raw_records", lambda: tables.upsert_raw(raw, f"{base}/tables/raw_records", run.run_id, run.at))
    manifest.action("daily_features", lambda: tables.upsert_features(gold, f"{base}/tables/daily_features", run.run_id))
    return raw, gold


def read_back(spark: SparkSession, manifest: Manifest, base: str, run: Run) -> DataFrame:
    """(layer, rows, stored_rows, complete) of every layer of a run, read as stored.

    The latest copy and a row of the feature table may be a later run's; such a layer counts as complete when what replaced it is not older.
    """
    layers = {name: snapshots.read_snapshot(spark, base, name, run.run_id) for name in LAYERS}
    checks = manifest.verify(layers, PARTITIONS)
    raw, gold = layers["bronze"], layers["gold"]

    def table(name: str, want: DataFrame | None, have: DataFrame | None, found: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        if want is None or have is None:
            rows = want.count() if want is not None else 0
            return spark.createDataFrame([(name, rows, 0, rows == 0 and name in manifest.done)], "layer string, rows bigint, stored_rows bigint, complete boolean")
        both = want.agg(F.count(F.lit(1)).alias("rows")).withColumn("stored_rows", found(want, have).agg(F.count(F.lit(1)).alias("n")).scalar())
        return both.select(F.lit(name).alias("layer"), "rows", "stored_rows", ((F.col("rows") == F.col("stored_rows")) & F.lit(name in manifest.done)).alias("complete"))

    stored = snapshots.read_if_present(spark, f"{base}/tables/raw_records")
    keyed = None if raw is None else tables.raw_rows(raw, run.run_id, run.at).select("record_key").distinct()
    key = F.col("record_key") == F.col("_key")
    checks = checks.unionByName(table("raw_records", keyed, stored, lambda want, have: want.join(
        have.filter(F.col("run_id") == run.run_id).select(F.col("record_key").alias("_key")), key, "left_semi")))
    day = F.col("data_date").cast("date")
    wanted = None if gold is None else gold.select("city", day.alias("data_date"))
    same = F.col("city").eqNullSafe(F.col("_city")) & F.col("data_date").eqNullSafe(F.col("_day"))
    checks = checks.unionByName(table("daily_features", wanted, tables.read_features(spark, f"{base}/tables/daily_features"), lambda want, have: want.join(
        have.filter(F.col("retrieved_at") >= F.lit(run.at)).select(F.col("city").alias("_city"), F.col("data_date").alias("_day")), same, "left_semi")))
    return checks


def _counts(spark: SparkSession, base: str, run_id: str | None) -> DataFrame | None:
    """A run's stored value counts; those of its gold layer where an older run stored none."""
    if run_id is None:
        return None
    stored = snapshots.read_snapshot(spark, base, "statistics", run_id)
    if stored is not None:
        return stored.drop("run_id")
    gold = snapshots.read_snapshot(spark, base, "gold", run_id)
    return None if gold is None else value_counts(gold, numeric_columns(gold))


def _execute(
    spark: SparkSession, landed: DataFrame, cities: DataFrame, base: str, run: Run, cities_processed: int,
    drift_against: str | None, thresholds: Mapping[str, float] | None, compare: bool, resume: bool,
) -> Published:
    started = time.perf_counter()
    calls = to_calls(landed.drop("landed_run"), run)
    manifest = Manifest(spark, base, run.run_id, resume)
    raw, gold = publish_layers(manifest, bronze(calls, run), checked_records(to_records(calls, cities), run), base, run)
    return _report(spark, manifest, raw, gold, base, run, cities_processed, started, drift_against, thresholds, compare)


def _report(
    spark: SparkSession, manifest: Manifest, raw: DataFrame, gold: DataFrame, base: str, run: Run,
    cities_processed: int, started: float, drift_against: str | None, thresholds: Mapping[str, float] | None, compare: bool,
) -> Published:
    """Reports come last: their presence says the run is complete. Their figures were observed while the layers were written."""
    folder = f"{base}/reports/run_id={run.run_id}"
    manifest.action("failed_requests", lambda: failed_requests(raw).write.mode("overwrite").json(f"{folder}/failed_requests"))
    counters = manifest.counters("bronze", "checked", "gold")
    planned = reports.observed_summary(spark, counters, run.run_id, cities_processed, time.perf_counter() - started, f"{folder}/failed_requests")
    # One row, read by every report.
    planned.coalesce(1).write.mode("overwrite").parquet(f"{folder}/summary")
    summary = spark.read.schema(planned.schema).parquet(f"{folder}/summary")
    drift_row = None
    if compare:
        now, earlier = (_counts(spark, base, run_id) for run_id in (run.run_id, drift_against))
        compared = drift(gold, None) if now is None else drift_of_counts(now, earlier, thresholds)
        drift_row = reports.drift_report(compared, run.run_id, drift_against)
        reports.write_report(drift_row, f"{base}/reports/drift/run_id={run.run_id}")
    manifest.action("call_log", lambda: call_log(raw).write.mode("overwrite").text(f"{folder}/call_log"))
    reports.write_report(reports.metrics_report(summary), f"{folder}/metrics")
    reports.write_report(reports.quality_report(summary), f"{folder}/quality")
    reports.write_report(reports.pipeline_report(summary, drift_row), f"{folder}/pipeline")
    return Published(run, base, summary, counters["failed_calls"])


def run_live(
    spark: SparkSession, landing: str, cities: DataFrame, base: str, run: Run | None = None,
    drift_against: str | None = None, thresholds: Mapping[str, float] | None = None, landed_run: str | None = None, resume: bool = False,
) -> Published:
    """One live run over the calls without a day, of one landing run if it is named. Drift is compared when an earlier run is named.

    ``resume`` goes on with the named run's last attempt and skips the layers it has written.
    """
    prepare(spark)
    landed = of_run(read_landed(spark, landing), landed_run).filter(F.col("data_date").isNull())
    return _execute(spark, landed, cities, base, run or Run.now(), cities.count(), drift_against, thresholds, True, resume)


def run_backfill(
    spark: SparkSession, landing: str, cities: DataFrame, base: str, start: date, end: date, run: Run | None = None,
    landed_run: str | None = None, resume: bool = False,
) -> Published:
    """One job over all days of the window and the history-capable sources; no drift comparison."""
    check_window(start, end)
    prepare(spark)
    capable = [name for name, past in SOURCES if past]
    wanted = F.col("data_date").between(start, end) & F.col("source").isin(capable)
    landed = of_window(of_run(read_landed(spark, landing), landed_run), wanted)
    return _execute(spark, landed, cities, base, run or Run.now(), cities.count(), None, None, False, resume)


