"""Incremental ingest of landed calls: a file stream whose end state equals one batch run over the same files.

Each micro-batch appends its checked rows as a version of one table and fuses again only the days it touched, from
all checked rows of those days. First-by-arrival is decided there, over stored rows, so the stream carries no
de-duplication state, needs no watermark to bound it, and never drops a late row. Replaying a batch adds nothing twice. Days whose rows
lie in many versions are folded into one, so the files to read do not grow with the number of micro-batches; ``first_rows``
(``hazeline.streaming.firsts``) keeps bounded state instead, for streams whose lateness is known.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazeline.contracts import DEDUP_KEY, LANDED, SILVER_COLUMNS
from hazeline.functions.keys import record_key
from hazeline.operators.bronze import bronze
from hazeline.operators.clean import clean
from hazeline.operators.fuse import fuse, lineage_rows
from hazeline.operators.standardize import Run, standardize
from hazeline.operators.survivors import first_by_arrival
from hazeline.operators.validate import ERRORS, RECORD_DATE, check, with_record_date
from hazeline.session import prepare
from hazeline.plans.run import LINEAGE_COLUMNS
from hazeline.sinks import tables
from hazeline.sinks.versions import VersionedTable
from hazeline.sources.landed import to_calls, to_records

_KEY = "arrival_key"
#: Versions in which a day's checked rows may lie before they are folded, and commits that readers may still use.
VERSIONS_OF_A_DAY, COMMITS_KEPT = 8, 4


def landed_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(landing).withColumn("_landed_at", F.col("_metadata.file_modification_time"))


def _batch_run(batch: DataFrame, batch_id: int, name: str) -> Run:
    """Run identity of a micro-batch; its clock is the newest file's time, so a replay gives the same rows."""
    newest = batch.agg(F.max(F.unix_micros("_landed_at"))).first()[0] or 0
    return Run(f"{name}_{batch_id:010d}", datetime.fromtimestamp(newest / 1_000_000, timezone.utc))


def checked_with_key(records: DataFrame, run: Run) -> DataFrame:
    """Checked rows that keep a digest of the raw de-duplication key."""
    keyed = records.withColumn(_KEY, record_key(DEDUP_KEY))
    keep = ("ord", _KEY)
    return check(standardize(with_record_date(clean(keyed, keep=keep)), run), keep=(*keep, RECORD_DATE))


def _of_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the given days; Spark prunes the stored partitions by them at run time."""
    return df.join(days, RECORD_DATE, "left_semi")


def apply_batch(batch: DataFrame, batch_id: int, cities: DataFrame, base: str, name: str = "stream") -> None:
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    run = _batch_run(batch, batch_id, name)
    calls = to_calls(batch.drop("_landed_at"), run)
    tables.upsert_raw(bronze(calls, run), f"{base}/tables/raw_records", run.run_id, run.at)

    checked = VersionedTable(spark, f"{base}/stream/checked", RECORD_DATE)
    rows = checked_with_key(to_records(calls, cities), run).withColumn("accepted", F.size(ERRORS) == 0)
    days = rows.select(RECORD_DATE).distinct() if not checked.append(rows, batch_id) else checked.newest_parts()
    days = days.filter(F.col(RECORD_DATE).isNotNull())
    stored = checked.read()
    touched = _of_days(stored, days)
    survivors = first_by_arrival(touched, [RECORD_DATE, _KEY])
    silver = survivors.filter("accepted").select("ord", *SILVER_COLUMNS, RECORD_DATE)
    tables.replace_partitions(fuse(silver), f"{base}/stream/gold", "data_date", days)
    tables.replace_partitions(lineage_rows(silver, LINEAGE_COLUMNS), f"{base}/stream/lineage", "data_date", days)
    fresh = tables.read_if_present(spark, f"{base}/stream/gold")
    fresh = fuse(silver.limit(0)) if fresh is None else _of_days(fresh.withColumn(RECORD_DATE, F.col("data_date")), days).drop(RECORD_DATE)
    # A key whose first record is now a rejected one has no gold row any more, and none in the feature table.
    keys = touched.select("city", F.col(RECORD_DATE).alias("data_date")).distinct()
    gone = keys.join(fresh.select("city", "data_date"), ["city", "data_date"], "left_anti")
    tables.upsert_features(fresh, f"{base}/tables/daily_features", run.run_id, gone)
    checked.compact(VERSIONS_OF_A_DAY)
    checked.vacuum(COMMITS_KEPT)


def ingest(
    spark: SparkSession, landing: str, cities: DataFrame, base: str, checkpoint: str,
    files_per_batch: int | None = None, name: str = "stream",
) -> StreamingQuery:
    """Process everything that has landed since the last call, then stop."""
    prepare(spark)
    return (
        landed_stream(spark, landing, files_per_batch)
        .writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, cities, base, name))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
