"""Intermediate tables in the folder the cluster shares; they cut lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.session import shared_folder

#: White space and words of the contracts, for SQL functions.
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame, name: str) -> DataFrame:
    """As written, and the step's shuffle files are dropped once the table stands."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before)


def discarded(*frames: DataFrame) -> None:
    """Removes tables that written or released made, once what was derived from them is written and nothing else reads them."""
    for frame in frames:
        files, spark = frame.inputFiles(), frame.sparkSession
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text) -> F.Column:
    """Number of words of the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place (from 0) in the order of the whole frame: places within range partitions, after the rows of those before."""
    parts = written(df.repartitionByRange(*order).withColumn("rank_part", F.spark_partition_id()), name)
    along = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = parts.groupBy("rank_part").agg(F.count("*").alias("rank_n"))
    starts = starts.select("rank_part", F.coalesce(F.sum("rank_n").over(along), F.lit(0)).alias("rank_start"))
    own = F.row_number().over(Window.partitionBy("rank_part").orderBy(*order))
    return parts.withColumn("rank_own", own).join(starts, "rank_part").withColumn(name, F.col("rank_start") + F.col("rank_own") - 1).select(*df.columns, name)


def rest_of(docs: DataFrame) -> Column:
    """All columns but id and text as one text, to order rows that agree in those."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("")
