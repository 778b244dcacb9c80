"""Groups that are too large for one row of a list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_large_groups(df: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """Add ``_slice`` so that each (keys, _slice) holds at most ``limit`` rows, slices in ``order``.

    Groups within the limit keep slice 0. A larger group is cut by its order value; since that is unique, a range of
    ``limit`` values cannot hold more rows. Counts are combined before the shuffle; Spark chooses the join by their size.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    marks = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(True).alias("_large"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    # Floor division that stays in BIGINT.
    cut = F.expr(f"(`{order}` - pmod(`{order}`, {limit}L)) div {limit}L")
    marked = df.join(marks, on, "left").withColumn("_slice", F.when(F.col("_large"), cut).otherwise(F.lit(0).cast("bigint")))
    return marked.select(*df.columns, "_slice")
