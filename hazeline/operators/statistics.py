"""Exact column statistics without gathering a column in one task.

Mean, extremes, deviation and missing counts come from one wide aggregate over the rows. Distinct count and median
come from (feature, value) counts, combined before the exchange, so a value that fills a third of a column is one
row per task. The median is found in two steps: values fall into numbered zones between two approximate quantiles,
exact zone counts tell which zone holds the middle rank, and only that zone's distinct values are ordered. The
quantiles only place the zone edges; the counts are exact, so the result is too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZONES = 4096
_EDGES = (0.45, 0.55)

STATISTICS = [
    "mean", "median", "minimum", "maximum", "standard_deviation", "missing_count", "missing_percentage",
    "unique_values", "record_count",
]


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    value = F.col(f"`{name}`").cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def _basics(df: DataFrame, columns: Sequence[str], side: list[str]) -> DataFrame:
    """One row per side and feature, from a single row of aggregates for each side."""
    aggregates = []
    for c in columns:
        v = F.col(f"`{c}`")
        aggregates.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(F.lit(1)).alias("record_count"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.min(v).alias("minimum"),
                F.max(v).alias("maximum"),
                F.stddev_samp(v).alias("standard_deviation"),
                F.percentile_approx(v, list(_EDGES), 1000).alias("edges"),
            ).alias(c)
        )
    one_row = df.groupBy(*side).agg(*aggregates)
    return one_row.select(*side, F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def _zone(value: Column, low: Column, high: Column) -> Column:
    """0 below the edges, ZONES + 1 above them, equal-width in between; never decreasing in ``value``."""
    width = high - low
    inside = F.when(
        (width > 0) & (width < float("inf")),
        F.least(F.floor((value - low) / width * ZONES), F.lit(ZONES - 1).cast("bigint")),
    ).otherwise(F.lit(0).cast("bigint"))
    return F.when(value < low, F.lit(0).cast("bigint")).when(value > high, F.lit(ZONES + 1).cast("bigint")).otherwise(inside + 1)


def column_statistics(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """One row per column with the nine statistics; figures of an empty or all-missing column are null.

    ``by`` names a column of few values that tells several datasets apart; all are done in one pass, each with rows of its own.
    """
    side = [by] if by else []
    keys = [*side, "feature"]
    numbers = df.select(*side, *[number(df, c).alias(c) for c in columns])
    basics = _basics(numbers, columns, side)
    # One row per column, known at plan time, so this side is small whatever the data.
    edges = F.broadcast(
        basics.select(*keys, F.col("edges")[0].alias("_low"), F.col("edges")[1].alias("_high"), F.col("n").alias("_n"))
    )
    counts = (
        numbers.unpivot([F.col(c) for c in side], [F.col(f"`{c}`") for c in columns], "feature", "value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    zoned = counts.join(edges, keys).withColumn("zone", _zone(F.col("value"), F.col("_low"), F.col("_high")))
    # At most ZONES + 2 rows per column.
    zones = zoned.groupBy(*keys, "zone", "_n").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("d"))
    running = Window.partitionBy(*keys).orderBy("zone").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = zones.withColumn("_before", F.sum("c").over(running) - F.col("c")).withColumn(
        "unique_values", F.sum("d").over(Window.partitionBy(*keys))
    )
    first_rank, last_rank = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    middle = placed.filter((F.col("_before") <= last_rank) & (F.col("_before") + F.col("c") > first_rank))
    inner = Window.partitionBy(*keys, "zone").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        zoned.select(*keys, "zone", "value", "c", "_n")
        # At most two zones per column hold the middle ranks.
        .join(F.broadcast(middle.select(*keys, "zone", "_before", "unique_values")), [*keys, "zone"])
        .withColumn("_upto", F.col("_before") + F.sum("c").over(inner))
        .withColumn("_from", F.col("_upto") - F.col("c"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("value")))

    medians = ranked.groupBy(*keys).agg(
        ((at(first_rank) + at(last_rank)) / 2).alias("median"), F.max("unique_values").alias("unique_values")
    )
    missing = F.col("record_count") - F.col("n")
    figures = {
        "missing_count": missing,
        "missing_percentage": F.when(F.col("record_count") > 0, missing / F.col("record_count") * 100),
        "unique_values": F.coalesce("unique_values", F.lit(0)),
    }
    # Both frames have one row per column.
    joined = basics.join(F.broadcast(medians), keys, "left")
    return joined.select(*keys, *[figures.get(s, F.col(s)).alias(s) for s in STATISTICS])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n): how often each number occurs; a null value counts the missing ones. Without rows there are no features.

    Exact and mergeable: the statistics of several datasets together follow from their counts alone.
    """
    numbers = df.select(*[number(df, c).alias(c) for c in columns])
    return numbers.unpivot([], [F.col(f"`{c}`") for c in columns], "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("feature", "value").agg(F.sum("n").alias("n"))


def _narrowed(rows: DataFrame) -> DataFrame:
    """(feature, _low, _high, _before, _n): the zones of the ranges (_low to _high, after _before values) that hold the middle ranks, two a feature at most."""
    zones = rows.withColumn("_zone", _zone(F.col("value"), F.col("_low"), F.col("_high"))).groupBy("feature", "_low", "_zone").agg(
        F.sum("n").alias("c"), F.min("value").alias("_first"), F.max("value").alias("_last"), F.max("_before").alias("_start"), F.max("_n").alias("_n")
    )
    # At most ZONES rows for each range.
    running = Window.partitionBy("feature", "_low").orderBy("_zone").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = zones.withColumn("_before", F.col("_start") + F.sum("c").over(running) - F.col("c"))
    middle = placed.filter((F.col("_before") <= F.expr("_n div 2")) & (F.col("_before") + F.col("c") > F.expr("(_n - 1) div 2")))
    return middle.select("feature", F.col("_first").alias("_low"), F.col("_last").alias("_high"), "_before", "_n")


def statistics_of(counts: DataFrame) -> DataFrame:
    """The nine statistics of each feature from stored value counts, as ``column_statistics`` gives them from the rows.

    The median narrows twice to one of ZONES zones before anything is ordered. The counts are read several times: store them first.
    """
    value, n = F.col("value"), F.col("n")
    present = F.when(value.isNotNull(), n)
    basics = counts.groupBy("feature").agg(
        F.sum("n").alias("record_count"), F.coalesce(F.sum(present), F.lit(0)).alias("_n"), (F.sum(value * n) / F.sum(present)).alias("mean"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.count("value").alias("unique_values"),
    )
    known = counts.filter(value.isNotNull())
    # One row for each feature, known by the columns; two for the zones of the middle.
    around = known.join(F.broadcast(basics.select("feature", "mean", "minimum", "maximum", "_n")), "feature")
    spread = around.groupBy("feature").agg(F.sum(n * (value - F.col("mean")) * (value - F.col("mean"))).alias("_squares"))
    middle = _narrowed(around.select("feature", "value", "n", F.col("minimum").alias("_low"), F.col("maximum").alias("_high"), F.lit(0).cast("bigint").alias("_before"), "_n"))

    def within(ranges: DataFrame) -> DataFrame:
        renamed = F.broadcast(ranges.withColumnRenamed("feature", "_of"))
        return known.join(renamed, (F.col("feature") == F.col("_of")) & value.between(F.col("_low"), F.col("_high"))).drop("_of")

    inner = Window.partitionBy("feature", "_low").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = within(_narrowed(within(middle))).withColumn("_upto", F.col("_before") + F.sum("n").over(inner)).withColumn("_from", F.col("_upto") - n)

    def at(rank: str) -> Column:
        return F.max(F.when((F.col("_from") <= F.expr(rank)) & (F.expr(rank) < F.col("_upto")), value))

    medians = ranked.groupBy("feature").agg(((at("(_n - 1) div 2") + at("_n div 2")) / 2).alias("median"))
    joined = basics.join(F.broadcast(spread), "feature", "left").join(F.broadcast(medians), "feature", "left")
    missing = F.col("record_count") - F.col("_n")
    figures = {
        "standard_deviation": F.when(F.col("_n") > 1, F.sqrt(F.col("_squares") / (F.col("_n") - 1))),
        "missing_count": missing,
        "missing_percentage": missing / F.col("record_count") * 100,
    }
    return joined.select("feature", *[figures.get(s, F.col(s)).alias(s) for s in STATISTICS])
