"""Running totals within keys, for keys of any size: rows are dealt out in ranges of (key, order), and what lies before a key's part is carried in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.tables import written

#: Of two totals of a key's parts, the total of both.
_JOINED: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
_START = Window.unboundedPreceding


def running(df: DataFrame, key: str, order: list[Column], totals: dict[str, tuple[str, str]], name: str) -> DataFrame:
    """Adds for each (output: aggregate, input column) the total of a key's rows up to and with this one. Keys aren't null; no input is null.

    Aggregates: sum, bit_xor. Only keys that lie in several ranges need carrying; there are fewer of them than ranges.
    """
    parts = written(df.repartitionByRange(F.col(key), *order).withColumn("run_part", F.spark_partition_id()), name)
    agg = {out: getattr(F, kind) for out, (kind, _) in totals.items()}
    ends = parts.groupBy("run_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    cut = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key)).groupBy(key).agg(F.count("*").alias("m")).filter("m > 1").select(key)
    pieces = parts.join(cut, key, "left_semi").groupBy("run_part", key).agg(*(agg[out](col).alias(out) for out, (_, col) in totals.items()))
    before = Window.partitionBy(key).orderBy("run_part").rowsBetween(_START, -1)  # one row for each range
    carried = pieces.select("run_part", key, *(agg[out](F.col(out)).over(before).alias(f"run_{out}") for out in totals)).filter(F.col(f"run_{next(iter(totals))}").isNotNull())
    own = Window.partitionBy("run_part", key).orderBy(*order).rowsBetween(_START, 0)
    rows = parts.select("*", *(agg[out](F.col(col)).over(own).alias(out) for out, (_, col) in totals.items())).join(carried, ["run_part", key], "left")
    whole = {out: F.when(F.col(f"run_{out}").isNull(), F.col(out)).otherwise(_JOINED[kind](F.col(out), F.col(f"run_{out}"))) for out, (kind, _) in totals.items()}
    return rows.select(*df.columns, *(c.alias(out) for out, c in whole.items()))
