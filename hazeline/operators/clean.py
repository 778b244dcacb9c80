"""Cleaning: null tokens, sentinels, half-even aqi, negative pollutants.

The type of a value decides what applies to it: a sentinel or a negative value counts only when it is a number,
never when it is text. Typed columns are decided at plan time, VARIANT columns value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.contracts import POLLUTANTS
from hazeline.functions import numbers as N
from hazeline.functions import payload as J
from hazeline.functions import text as X


def _pollutant_number(value: Column, is_float: bool, rounded: bool) -> Column:
    known = N.without_sentinels(value)
    if rounded and is_float:
        return N.half_even(known)
    return F.when(F.isnan(known), known).otherwise(N.without_negatives(known)) if is_float else N.without_negatives(known)


def _clean_variant(value: Column, pollutant: bool, rounded: bool) -> Column:
    kind = J.kind(value)
    text = X.null_token(F.try_variant_get(value, "$", "string")).cast("variant")
    cleaned = F.when(kind == "STRING", text)
    if pollutant:
        number = F.try_variant_get(value, "$", "double")
        known = N.without_sentinels(number).isNotNull()
        kept = F.when(known & (number >= 0), value)
        if rounded:
            cleaned = cleaned.when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), F.when(known, N.half_even(number)).cast("variant"))
        cleaned = cleaned.when(J.is_number(kind), kept)
    return cleaned.when(kind != "VOID", value)


def clean_value(value: Column, data_type: T.DataType, *, pollutant: bool = False, rounded: bool = False) -> Column:
    """Cleaned form of one column, of the same type (aqi floats stay doubles holding whole numbers)."""
    if isinstance(data_type, T.StringType):
        return X.null_token(value)
    if isinstance(data_type, T.VariantType):
        return _clean_variant(value, pollutant, rounded)
    if pollutant and isinstance(data_type, T.NumericType):
        is_float = not isinstance(data_type, T.IntegralType)
        return _pollutant_number(value.cast("double") if is_float else value, is_float, rounded)
    return value


def clean(
    df: DataFrame,
    pollutants: Sequence[str] = POLLUTANTS,
    rounded: Sequence[str] = ("aqi",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Clean every top-level column except those in ``keep``."""
    cleaned = {
        f.name: clean_value(
            F.col(f"`{f.name}`"), f.dataType, pollutant=f.name in pollutants, rounded=f.name in rounded
        ).alias(f.name)
        for f in df.schema.fields
        if f.name not in keep
    }
    return df.select(*[cleaned.get(name, F.col(f"`{name}`")) for name in df.columns])
