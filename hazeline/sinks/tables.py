"""Keyed tables on plain Parquet. The feature table is versioned: a merge writes only the partitions the incoming rows touch, and a run that dies leaves
the former version readable. A run's own partition of the raw table, and days of a stream's layers, are replaced directly.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.contracts import BRONZE_COLUMNS, GOLD_KEY
from hazeline.functions.keys import record_key
from hazeline.operators.features import feature_rows
from hazeline.operators.survivors import one_per_key
from hazeline.operators.upsert import merge_latest
from hazeline.sinks.snapshots import read_if_present
from hazeline.sinks.versions import VersionedTable, read_versioned

FEATURE_PARTITION = "data_date"


def _drop_partitions(spark: SparkSession, path: str, partition: str, values: list) -> None:
    """Removes the folders of partitions that have no rows any more; dynamic overwrite leaves those alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for value in values:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{partition}={value}"), True)


def _write_partitions(rows: DataFrame, path: str, partition: str) -> None:
    # Rebalancing keeps files near the advisory size and splits a partition that holds most rows.
    rows.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: str, touched: DataFrame) -> None:
    """The touched partitions (days, one column) hold exactly these rows afterwards."""
    spark = rows.sparkSession
    _write_partitions(rows, path, partition)
    left = read_if_present(spark, path)
    if left is not None:
        days = touched.select(F.col(touched.columns[0]).alias("_day"))
        empty = days.join(rows.select(F.col(partition).alias("_have")).distinct(), F.col("_day") == F.col("_have"), "left_anti")
        # One entry for each day of a micro-batch that lost all its rows.
        _drop_partitions(spark, path, partition, [r[0] for r in empty.collect()])


def raw_rows(bronze: DataFrame, run_id: str, created_at: datetime | None = None) -> DataFrame:
    """Bronze rows with their record key."""
    keyed = bronze.select(*BRONZE_COLUMNS).withColumn("record_key", record_key(BRONZE_COLUMNS, {"run_id": F.lit(run_id)}))
    stamp = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    return keyed.withColumn("created_at", stamp)


def upsert_raw(bronze: DataFrame, path: str, run_id: str, created_at: datetime | None = None) -> None:
    """Raw-table upsert on the record key. The key covers the run id, so only that run's partition can collide, and the
    run's own rows are all that belongs in it: it is replaced directly."""
    rows = one_per_key(raw_rows(bronze, run_id, created_at), ["record_key"], [F.lit(1)])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def upsert_features(gold: DataFrame, path: str, run_id: str, gone: DataFrame | None = None) -> None:
    """Feature-table upsert on (city, data_date): the latest ``retrieved_at`` wins, and keys in ``gone`` are removed. Partitioned by day, versioned."""
    rows = feature_rows(gold, run_id).withColumn("data_date", F.col("data_date").cast("date"))
    VersionedTable(gold.sparkSession, path, FEATURE_PARTITION).merge(rows, lambda old, new: merge_latest(old, new, GOLD_KEY), gone)


def read_features(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest feature table, None while nothing was published."""
    return read_versioned(spark, path, FEATURE_PARTITION)
