"""Versioned tables on plain Parquet: every write goes to a version directory of its own, and a commit written last makes it visible.

``<path>/data/version=<n>/<partition>=<value>`` holds rows, ``<path>/commits/version=<n>`` says in which versions each partition's rows lie. A reader takes the
latest commit, so it sees the table before a write or after it and nothing in between; a write that dies leaves files that no commit names, and the next one
overwrites them. A merge writes only the partitions it touches and the commit carries the others over. Appends add a version to their partitions; compaction
folds those of partitions with many versions into one, and vacuum drops what no kept commit names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.sinks.snapshots import read_if_present

Merge = Callable[[DataFrame, DataFrame], DataFrame]
_VERSION, _PART, _HOLDER, _APPLIED = "_version", "_part", "_holder", "_applied"


class VersionedTable:
    """One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.partition = spark, partition
        self.data, self.commits = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/commits"

    def _commits(self) -> DataFrame | None:
        return read_if_present(self.spark, self.commits)

    def latest(self) -> tuple[int, int]:
        """Number of the latest commit and of the last batch it holds; -1 each if there is none."""
        commits = self._commits()
        last = commits.agg(F.max(F.struct(_VERSION, _APPLIED)).alias("last")).first().last if commits is not None else None
        return (last[_VERSION], last[_APPLIED]) if last else (-1, -1)

    def parts(self, version: int | None = None) -> DataFrame | None:
        """(part, holder): the versions in which each partition's rows lie, as of a commit."""
        version = self.latest()[0] if version is None else version
        return None if version < 0 else self._commits().filter(F.col(_VERSION) == version).filter(F.col(_HOLDER) >= 0).select(_PART, _HOLDER)

    def _rows(self, parts: DataFrame) -> DataFrame | None:
        stored = read_if_present(self.spark, self.data)
        if stored is None:
            return None
        # The holders and partitions wanted prune the files at run time.
        at = parts.select(F.col(_PART).alias("_want"), F.col(_HOLDER).alias("_of"))
        on = (F.col(_VERSION) == F.col("_of")) & F.col(self.partition).cast("string").eqNullSafe(F.col("_want"))
        return stored.join(at, on, "left_semi").drop(_VERSION)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a commit, the latest if none is named; None while there is no commit."""
        parts = self.parts(version)
        return None if parts is None else self._rows(parts)

    def _store(self, rows: DataFrame, version: int) -> DataFrame:
        """Writes rows as a version and returns its (part, holder)."""
        folder = f"{self.data}/{_VERSION}={version}"
        # Rebalancing keeps files near the advisory size and splits a partition that holds most rows.
        rows.hint("rebalance", self.partition).write.mode("overwrite").partitionBy(self.partition).parquet(folder)
        found = read_if_present(self.spark, folder)
        if found is None:
            return self.spark.createDataFrame([], f"{_PART} string, {_HOLDER} bigint")
        return found.select(F.col(self.partition).cast("string").alias(_PART)).distinct().withColumn(_HOLDER, F.lit(version).cast("bigint"))

    def _commit(self, parts: DataFrame, version: int, applied: int) -> None:
        """One file, written last. A row without holder stands for a table without rows."""
        base = self.spark.createDataFrame([(None, -1)], f"{_PART} string, {_HOLDER} bigint")
        rows = parts.select(_PART, _HOLDER).unionByName(base).withColumn(_APPLIED, F.lit(applied).cast("bigint"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.commits}/{_VERSION}={version}")

    def _kept(self, version: int, touched: DataFrame | None) -> DataFrame:
        """(part, holder) of a commit without the touched parts."""
        if version < 0:
            return self.spark.createDataFrame([], f"{_PART} string, {_HOLDER} bigint")
        parts = self.parts(version)
        if touched is None:
            return parts
        gone = touched.select(F.col(touched.columns[0]).cast("string").alias("_gone")).distinct()
        return parts.join(gone, F.col(_PART).eqNullSafe(F.col("_gone")), "left_anti")

    def newest_parts(self) -> DataFrame:
        """The partitions, in their own type, that the latest version's rows lie in."""
        version = self.latest()[0]
        parts = self.parts(version).filter(F.col(_HOLDER) == version)
        stored = read_if_present(self.spark, self.data)
        kind = stored.schema[self.partition].dataType if stored is not None else "string"
        return parts.select(F.col(_PART).cast(kind).alias(self.partition))

    def append(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Adds rows. A numbered batch that a commit already holds is left out, so replays add nothing."""
        version, applied = self.latest()
        if batch is not None and batch <= applied:
            return False
        fresh = self._store(rows, version + 1)
        self._commit(self._kept(version, None).unionByName(fresh), version + 1, applied if batch is None else batch)
        return True

    def replace(self, rows: DataFrame, touched: DataFrame) -> None:
        """The touched partitions (one column) hold exactly these rows afterwards."""
        version, applied = self.latest()
        fresh = self._store(rows, version + 1)
        self._commit(self._kept(version, touched).unionByName(fresh), version + 1, applied)

    def merge(self, incoming: DataFrame, merge: Merge, gone: DataFrame | None = None) -> None:
        """Merges rows into the partitions they touch; rows with a key in ``gone`` leave the table, and keys with nulls do too."""
        touched = incoming.select(self.partition)
        touched = (touched if gone is None else touched.unionByName(gone.select(self.partition))).distinct()
        version, _ = self.latest()
        old = None
        if version >= 0:
            wanted = touched.select(F.col(self.partition).cast("string").alias("_want_part"))
            old = self._rows(self.parts(version).join(wanted, F.col(_PART).eqNullSafe(F.col("_want_part")), "left_semi"))
        if old is None:
            old = incoming.limit(0)
        elif gone is not None:
            keys = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns])
            on = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in gone.columns]
            old = old.join(keys, on, "left_anti")
        self.replace(merge(old, incoming), touched)

    def compact(self, most: int = 8) -> bool:
        """Folds the rows of partitions that lie in more than ``most`` versions into one new version."""
        version, applied = self.latest()
        if version < 0:
            return False
        many = self.parts(version).groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(_PART)
        if many.isEmpty():
            return False
        spread = self.parts(version).join(many.withColumnRenamed(_PART, "_many"), F.col(_PART).eqNullSafe(F.col("_many")), "left_semi")
        fresh = self._store(self._rows(spread), version + 1)
        self._commit(self._kept(version, many).unionByName(fresh), version + 1, applied)
        return True

    def vacuum(self, keep: int = 1) -> None:
        """Drops all but the latest commits and the versions that only dropped ones name. Readers of older commits must be done."""
        commits = self._commits()
        if commits is None:
            return
        versions = sorted(r[0] for r in commits.select(_VERSION).distinct().collect())
        kept = versions[-keep:]
        named = {r[0] for r in commits.filter(F.col(_VERSION).isin(kept)).select(_HOLDER).distinct().collect()}
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.commits)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        dropped = [f"{self.commits}/{_VERSION}={v}" for v in versions if v not in kept]
        dropped += [f"{self.data}/{_VERSION}={v}" for v in range(versions[-1] + 1) if v not in named]
        for path in dropped:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def read_versioned(spark: SparkSession, path: str, partition: str) -> DataFrame | None:
    """The latest rows of a versioned table, None while it has no commit."""
    return VersionedTable(spark, path, partition).read()
