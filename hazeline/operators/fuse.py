"""Fusion to one row per (city, day): the first record by arrival wins whole, all records of the group are its lineage.

Gold holds the winner and the number of records. Lineage is a long table, one row per source record, at every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.sizing import slice_large_groups
from hazeline.operators.survivors import first_by_arrival

MERGED = "merged"
FUSION_KEY = ["city", "record_date"]


def fuse_winners(df: DataFrame, keys: Sequence[str] = FUSION_KEY, ord: str = "ord") -> DataFrame:
    """Winning rows only. Losers are dropped before the exchange."""
    return first_by_arrival(df, keys, ord)


def lineage_rows(silver: DataFrame, record_columns: Sequence[str], ord: str = "ord") -> DataFrame:
    """The whole lineage, without an exchange: fusion key, arrival order, source, endpoint and the source record."""
    return silver.select(
        F.lit(MERGED).alias("source_api"),
        "city",
        F.col("record_date").alias("data_date"),
        F.col(ord).alias("ord"),
        "source",
        "endpoint",
        F.struct(*[F.col(f"`{c}`") for c in record_columns]).alias("source_record"),
    )


def lineage_lists(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = FUSION_KEY, ord: str = "ord") -> DataFrame:
    """For reading: the keys and one array per column, in arrival order. Every record is in; choose the keys and narrow columns."""
    item = F.struct(F.col(ord).alias("_ord"), *[F.col(f"`{c}`") for c in columns])
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return lists.select(*keys, *[F.col("_items")[c].alias(c) for c in columns])


def gather(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = FUSION_KEY, ord: str = "ord", limit: int = 1_000) -> DataFrame:
    """For reading in pages: rows of each group as ``items`` in arrival order, at most ``limit`` to a row. No record is left out.

    A group within the limit is one row with ``slice`` 0; a larger one is several rows whose slices sort in arrival order.
    """
    sliced = slice_large_groups(df, keys, ord, limit)
    item = F.struct(F.col(ord).alias("_ord"), *[F.col(f"`{c}`") for c in columns])
    return sliced.groupBy(*keys, F.col("_slice").alias("slice")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def fuse(silver: DataFrame, ord: str = "ord", include_payload: bool = True) -> DataFrame:
    """Gold rows: the winner's columns, ``merged`` markers, the fusion day and ``lineage_records``, the size of the group.

    ``silver`` needs ``city``, ``record_date``, ``source``, ``endpoint``, ``status`` and the arrival order. Only winners cross
    the exchange whole; counts are combined before theirs, on the same keys.
    """
    columns = [c for c in silver.columns if c not in (ord, "record_date", "lineage") and (include_payload or c != "raw_payload")]
    winners = fuse_winners(silver.select(ord, "record_date", *columns), FUSION_KEY, ord)
    counts = silver.groupBy(*FUSION_KEY).agg(F.count(F.lit(1)).alias("lineage_records"))
    marks = counts.select(F.col("city").alias("_city"), F.col("record_date").alias("_day"), "lineage_records")
    both = winners.join(marks, F.col("city").eqNullSafe(F.col("_city")) & F.col("record_date").eqNullSafe(F.col("_day")))
    fixed = {"source": F.lit(MERGED), "endpoint": F.array(F.lit(MERGED)), "status": F.lit(MERGED), "data_date": F.col("record_date")}
    names = columns + [c for c in ("data_date",) if c not in columns]
    return both.select(*[fixed.get(c, F.col(f"`{c}`")).alias(c) for c in names], "lineage_records")
