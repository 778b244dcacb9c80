"""A run's publishing as named steps with a manifest, so that a run that died goes on where it stopped and every layer can be read back and checked.

Each step writes one layer and then, in ``<base>/manifest/run_id=<id>/attempt=<n>/layer=<name>``, one row with the number of rows written, their digest (a
sum of row hashes, so order and files don't matter) and the step's counters. All of them are observed while the layer is written, as the last operator
before the writer: nothing is scanned a second time for them. A resumed attempt skips the steps that have a row. The landed calls of an attempt must not
change while it is resumed; a new attempt does everything again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.sinks.snapshots import read_if_present

_ENTRY = "rows bigint, digest string, counters map<string,bigint>"


def _hashable(field: T.StructField) -> Column:
    """Maps and variants have no hash of their own."""
    value = F.col(f"`{field.name}`")
    kinds, found = [field.dataType], False
    while kinds:
        kind = kinds.pop()
        found |= isinstance(kind, (T.MapType, T.VariantType))
        kinds += [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return F.to_json(F.struct(value)) if found else value


def digest(df: DataFrame, partitions: tuple[str, ...] = ()) -> Column:
    """Sum of row hashes over the columns by name. Values of partition columns count as text, as folders keep them, an empty one as null."""
    fields = sorted((f for f in df.schema.fields if f.name != "run_id"), key=lambda f: f.name)
    values = [F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")) if f.name in partitions else _hashable(f) for f in fields]
    return F.coalesce(F.sum(F.xxhash64(*values).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


class Manifest:
    """The steps of one run's latest attempt; a new attempt starts unless the last one is resumed."""

    def __init__(self, spark: SparkSession, base: str, run_id: str, resume: bool = False):
        self.spark, self.path = spark, f"{base.rstrip('/')}/manifest/run_id={run_id}"
        entries = read_if_present(spark, self.path)
        last = entries.agg(F.max("attempt")).first()[0] if entries is not None else None
        self.attempt = 0 if last is None else last if resume else last + 1
        # One row for each step.
        done = entries.filter(F.col("attempt") == self.attempt).collect() if entries is not None else []
        self.done: dict[str, Row] = {r.layer: r for r in done}
        self.written: list[str] = []

    def step(
        self, layer: str, rows: DataFrame, write: Callable[[DataFrame], object], counters: Mapping[str, Column] | None = None,
        partitions: tuple[str, ...] = (),
    ) -> None:
        """Writes the layer and then its row, unless this attempt has it. ``write`` gets the rows, observed, and must write each of them once."""
        if layer in self.done:
            return
        seen = Observation()
        named = [value.alias(name) for name, value in (counters or {}).items()]
        write(rows.observe(seen, F.count(F.lit(1)).alias("_rows"), digest(rows, partitions).alias("_digest"), *named))
        self._enter(layer, seen.get)

    def action(self, layer: str, act: Callable[[], object]) -> None:
        """A step without rows of its own to observe; done again, it must end the same."""
        if layer not in self.done:
            act()
            self._enter(layer, {})

    def _enter(self, layer: str, seen: Mapping) -> None:
        counters = {k: int(v) for k, v in seen.items() if k not in ("_rows", "_digest")}
        row = self.spark.createDataFrame([(seen.get("_rows"), seen.get("_digest"), counters)], _ENTRY)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/attempt={self.attempt}/layer={layer}")
        self.done[layer] = row.first()
        self.written.append(layer)

    def counters(self, *layers: str) -> dict[str, int]:
        return {k: v for layer in layers for k, v in self.done[layer].counters.items()}

    def verify(self, stored: Mapping[str, DataFrame | None], partitions: Mapping[str, tuple[str, ...]] | None = None) -> DataFrame:
        """(layer, rows, stored_rows, complete) of layers read back: complete when number and digest equal what was written."""
        checks = []
        for layer, df in stored.items():
            entry = self.done.get(layer)
            wanted = [F.lit(layer).alias("layer"), F.lit(entry.rows if entry else None).cast("bigint").alias("rows")]
            if df is None:
                df = self.spark.createDataFrame([], "run_id string, _none string")
                found, same = df.agg(F.count(F.lit(1)).alias("stored_rows")), F.lit(entry is not None and entry.rows == 0)
            else:
                found = df.agg(F.count(F.lit(1)).alias("stored_rows"), digest(df, (partitions or {}).get(layer, ())).alias("_digest"))
                same = F.coalesce(F.col("_digest") == F.lit(entry.digest if entry else None).cast("string"), F.lit(False))
            checks.append(found.select(*wanted, "stored_rows", same.alias("complete")))
        return reduce(DataFrame.unionByName, checks)
