"""Key-based merges of an incoming frame into an existing one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.survivors import one_per_key


def merge_by_key(target: DataFrame, incoming: DataFrame, keys: Sequence[str], incoming_order: str | None = None) -> DataFrame:
    """Incoming rows replace target rows of the same key.

    No broadcast hint: Spark broadcasts the incoming keys when their measured size allows it, and otherwise shuffles,
    with skewed target partitions split at run time.
    """
    order = [F.col(incoming_order).desc_nulls_last()] if incoming_order else [F.lit(1)]
    fresh = one_per_key(incoming, keys, order)
    fresh_keys = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return target.join(fresh_keys, on, "left_anti").unionByName(fresh)


def merge_latest(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str = "retrieved_at", ord: str | None = None
) -> DataFrame:
    """The highest version of every key over both frames; on a tie the incoming row wins, then the later arrival."""
    both = existing.withColumn("_generation", F.lit(0)).unionByName(
        incoming.withColumn("_generation", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col(version).desc_nulls_last(), F.col("_generation").desc()]
    order += [F.col(ord).desc_nulls_last()] if ord else []
    return one_per_key(both, keys, order).drop("_generation")
