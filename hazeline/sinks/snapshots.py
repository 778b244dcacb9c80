"""Per-run snapshots under ``<base>/<layer>/runs/run_id=<id>``, and the overwritten latest copy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def union_sorted(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of frames with different columns: the sorted union of all names, nulls where one is missing."""
    return sorted_columns(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def run_path(base: str, layer: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{layer}/runs/run_id={run_id}"


def write_snapshot(df: DataFrame, base: str, layer: str, run_id: str, partition_by: Sequence[str] = ()) -> str:
    """Overwrite the one directory of this run, so publishing again changes nothing else."""
    path = run_path(base, layer, run_id)
    rows = sorted_columns(df.drop("run_id"))
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        # An empty directory has no schema to read.
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_snapshot(spark: SparkSession, base: str, layer: str, run_id: str) -> DataFrame | None:
    """One run's snapshot, or None when that run left none."""
    df = read_if_present(spark, run_path(base, layer, run_id))
    return None if df is None else df.withColumn("run_id", F.lit(run_id))


def write_latest(df: DataFrame, path: str) -> None:
    """The latest raw file: replaced by every run."""
    sorted_columns(df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV export: sorted columns, header, nested values as JSON, nulls empty."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = [
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in sorted(df.schema.fields, key=lambda f: f.name)
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)
