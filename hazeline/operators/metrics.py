"""Run counters and quality figures, all with partial aggregation ahead of a small exchange."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.contracts import MEASURES, SOURCES
from hazeline.operators.bronze import SUCCESS, UNKNOWN


def api_summary(calls: DataFrame) -> DataFrame:
    """Full successes and everything else per source."""
    return calls.groupBy("source").agg(
        F.count_if(F.col("status") == SUCCESS).alias("success"),
        F.count_if(F.col("status") != SUCCESS).alias("failed"),
    )


def missing_values(gold: DataFrame, fields: Sequence[str] = MEASURES) -> DataFrame:
    """Null counts of the monitored fields; fields without nulls are left out."""
    one_row = gold.agg(*[F.count_if(F.col(f"`{f}`").isNull()).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("missing")) for f in fields]))
    return one_row.select(pairs.alias("p")).select("p.field", "p.missing").filter("missing > 0")


def call_counts(calls: DataFrame, has_record: Column) -> DataFrame:
    return calls.agg(
        F.count(F.lit(1)).alias("total_api_calls"),
        F.count_if(F.col("status") == SUCCESS).alias("successful_calls"),
        F.count_if(F.col("status") != SUCCESS).alias("failed_calls"),
        F.count_if(has_record).alias("source_rows"),
    )


def row_counts(checked: DataFrame, valid: Column, keys: Sequence[str] = ("city", "record_date")) -> DataFrame:
    """De-duplicated, valid and fused row counts in one pass: groups first, then one row."""
    groups = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("v"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("dedup_rows"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("valid_rows"),
        F.count_if(F.col("v") > 0).alias("gold_rows"),
    )


def side_by_side(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row frames as one row, through a union of named counters (no join)."""
    names = [c for f in frames for c in f.columns]
    long = [
        f.select(F.explode(F.create_map(*[x for c in f.columns for x in (F.lit(c), F.col(c).cast("bigint"))])).alias("name", "value"))
        for f in frames
    ]
    rows = reduce(DataFrame.unionByName, long)
    return rows.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def run_counters(
    calls: DataFrame, has_record: Column, checked: DataFrame, valid: Column, keys: Sequence[str] = ("city", "record_date")
) -> DataFrame:
    """All counters of a run as one row."""
    c = side_by_side([call_counts(calls, has_record), row_counts(checked, valid, keys)])
    return c.select(
        "total_api_calls",
        "successful_calls",
        "failed_calls",
        F.col("valid_rows").alias("rows_processed"),
        F.greatest(F.lit(0), F.col("source_rows") - F.col("valid_rows")).alias("rows_skipped"),
        (F.col("dedup_rows") - F.col("valid_rows")).alias("invalid_records"),
        (F.col("source_rows") - F.col("dedup_rows")).alias("duplicates_removed"),
        F.col("valid_rows").alias("silver_rows"),
        "gold_rows",
    )


def known_source(source: Column) -> Column:
    """A provider's name, or ``unknown`` for any other text, so that summaries stay as short as the provider list."""
    return F.when(source.isin(*(name for name, _ in SOURCES)), source).otherwise(UNKNOWN)


def call_counters(has_record: Column) -> dict[str, Column]:
    """Aggregates over bronze rows: calls of the run, and by provider ``calls:``, ``success:`` and ``failed:``."""
    status, source = F.col("status"), known_source(F.col("source"))
    counters = {
        "total_api_calls": F.count(F.lit(1)), "successful_calls": F.count_if(status == SUCCESS),
        "failed_calls": F.count_if(status != SUCCESS), "source_rows": F.count_if(has_record),
    }
    for name in [*(n for n, _ in SOURCES), UNKNOWN]:
        counters |= {
            f"calls:{name}": F.count_if(source == name), f"success:{name}": F.count_if((source == name) & (status == SUCCESS)),
            f"failed:{name}": F.count_if((source == name) & (status != SUCCESS)),
        }
    return counters


def record_counters(valid: Column) -> dict[str, Column]:
    """Aggregates over checked rows."""
    return {"dedup_rows": F.count(F.lit(1)), "valid_rows": F.count_if(valid)}


def gold_counters(fields: Sequence[str] = MEASURES) -> dict[str, Column]:
    """Aggregates over gold rows: fused days, and nulls of each monitored field as ``missing:``."""
    return {"gold_rows": F.count(F.lit(1))} | {f"missing:{f}": F.count_if(F.col(f"`{f}`").isNull()) for f in fields}


def counters_of(seen: Mapping[str, int]) -> dict[str, int]:
    """The run's counters from those observed in bronze, checked and gold rows."""
    return {
        "total_api_calls": seen["total_api_calls"],
        "successful_calls": seen["successful_calls"],
        "failed_calls": seen["failed_calls"],
        "rows_processed": seen["valid_rows"],
        "rows_skipped": max(0, seen["source_rows"] - seen["valid_rows"]),
        "invalid_records": seen["dedup_rows"] - seen["valid_rows"],
        "duplicates_removed": seen["source_rows"] - seen["dedup_rows"],
        "silver_rows": seen["valid_rows"],
        "gold_rows": seen["gold_rows"],
    }
