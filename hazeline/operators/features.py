"""Feature-table rows: projection to the listed columns and coercion where bad values become null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.contracts import FEATURE_COLUMNS, FEATURE_INSTANTS, FEATURE_NUMBERS, FEATURE_TEXTS
from hazeline.functions import numbers as N
from hazeline.functions import times as D


def project_features(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """The listed columns that are present, in list order; absent ones are not added."""
    return df.select(*[c for c in columns if c in df.columns])


def _instant(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return D.instant_from_text(value)
    return value.cast("timestamp") if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)) else D.epoch_instant(value.cast("double"))


def _number(value: Column, data_type: T.DataType) -> Column:
    return N.number_from_text(value) if isinstance(data_type, T.StringType) else value.cast("double")


def _text(value: Column, data_type: T.DataType) -> Column:
    return F.array_join(value, ",") if isinstance(data_type, T.ArrayType) else value.cast("string")


def coerce_features(
    df: DataFrame,
    instants: Sequence[str] = FEATURE_INSTANTS,
    numbers: Sequence[str] = FEATURE_NUMBERS,
    texts: Sequence[str] = FEATURE_TEXTS,
) -> DataFrame:
    """Instants, doubles and text by column list; other columns pass unchanged."""
    rules = dict.fromkeys(instants, _instant) | dict.fromkeys(numbers, _number) | dict.fromkeys(texts, _text)
    return df.select(*[
        rules[f.name](F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.name in rules else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def feature_rows(gold: DataFrame, run_id: str) -> DataFrame:
    """Gold rows ready for the feature table, stamped with the publishing run."""
    return coerce_features(project_features(gold.withColumn("run_id", F.lit(run_id))))
