"""Validation against a field list: lax coercion, bounds, required fields, and a list of broken rules per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.contracts import SILVER_FIELDS, Field, field_type
from hazeline.functions import numbers as N
from hazeline.functions import payload as J
from hazeline.functions import text as X
from hazeline.functions import times as D
from hazeline.functions.once import computed_once

ERRORS = "errors"
RECORD_DATE = "record_date"


def _number(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return N.number_from_text(value)
    if isinstance(data_type, T.VariantType):
        kind = J.kind(value)
        return F.when(kind == "STRING", N.number_from_text(F.try_variant_get(value, "$", "string"))).when(
            J.is_number(kind), F.try_variant_get(value, "$", "double")
        )
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    return F.lit(None).cast("double")


def _whole(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StringType):
        return N.whole_from_text(value)
    if isinstance(data_type, T.VariantType):
        kind = J.kind(value)
        return F.when(kind == "STRING", N.whole_from_text(F.try_variant_get(value, "$", "string"))).when(
            J.is_number(kind), N.whole_from_number(F.try_variant_get(value, "$", "double"))
        )
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(data_type, T.NumericType):
        return N.whole_from_number(value.cast("double"))
    return F.lit(None).cast("bigint")


def _instant(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    if isinstance(data_type, T.NumericType):
        return D.epoch_instant(value.cast("double"))
    return D.instant_from_text(value.cast("string"))


def _day(value: Column, data_type: T.DataType) -> Column:
    return value if isinstance(data_type, T.DateType) else D.day_from_text(value.cast("string"))


def _endpoints(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.ArrayType):
        return value.cast("array<string>")
    return F.when(X.null_token(value).isNotNull(), F.array(value))


def coerce(field: Field, data_type: T.DataType) -> tuple[Column, Column]:
    """Coerced value and the test that the raw value could not be coerced."""
    raw = F.col(f"`{field.name}`")
    present = raw.isNotNull()
    if isinstance(data_type, T.NullType):
        return F.lit(None).cast(field_type(field)), F.lit(False)
    if isinstance(data_type, T.VariantType):
        present = present & (J.kind(raw) != "VOID")
    if field.kind == "text":
        if isinstance(data_type, T.StringType):
            return X.null_token(raw), F.lit(False)
        return F.lit(None).cast("string"), present  # a number is not text
    if field.kind == "lineage":
        return raw, F.lit(False)
    if field.kind == "endpoints":
        return _endpoints(raw, data_type), F.lit(False)
    if field.kind == "payload":
        # Text is parsed once: as a document when it opens like one, else to see whether it is a scalar.
        opens = J.is_document(X.null_token(raw))
        return F.when(opens, J.document_text(raw)), F.when(~opens, J.document_text(raw).isNotNull())
    value = {"number": _number, "integer": _whole, "instant": _instant, "day": _day}[field.kind](raw, data_type)
    return value, present & value.isNull()


def _rules(field: Field, value: Column, uncoerced: Column) -> list[tuple[Column, str]]:
    rules = [(uncoerced, f"{field.name}:type")]
    if field.required:
        rules.append((value.isNull() & ~uncoerced, f"{field.name}:required"))
    if field.kind == "number" and (field.low is not None or field.high is not None):
        outside = F.isnan(value)  # NaN compares above every number
        if field.low is not None:
            outside = outside | (value < field.low)
        if field.high is not None:
            outside = outside | (value > field.high)
        rules.append((outside, f"{field.name}:range"))
    elif field.low is not None:
        rules.append((value < field.low, f"{field.name}:range"))
    return rules


def check(df: DataFrame, fields: Sequence[Field] = SILVER_FIELDS, keep: Sequence[str] = ()) -> DataFrame:
    """Contract columns in contract order (absent ones null), ``keep``, and ``errors``.

    Columns outside the contract are dropped. A row is valid when ``errors`` is empty. The rules read coerced columns
    that are computed once, also when rows are filtered by ``errors``.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    coerced, flags = {}, {}
    for field in fields:
        if field.name in types:
            value, bad = coerce(field, types[field.name])
        else:
            value, bad = F.lit(None).cast(field_type(field)), F.lit(False)
        coerced[field.name] = value
        flags[f"_bad_{field.name}"] = F.coalesce(bad, F.lit(False))
    typed = computed_once(df, coerced | flags, keep)
    rules = [r for f in fields for r in _rules(f, F.col(f"`{f.name}`"), F.col(f"_bad_{f.name}"))]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    narrowed = [F.col(f"`{f.name}`").try_cast(field_type(f)).alias(f.name) if f.name == "response_time_ms"
                else F.col(f"`{f.name}`") for f in fields]
    return typed.select(*narrowed, *keep, broken.alias(ERRORS))


def with_record_date(df: DataFrame) -> DataFrame:
    """Add the fusion day: ``data_date``, else the day of ``timestamp`` in the offset it was written with."""
    types = {f.name: f.dataType for f in df.schema.fields}
    stamp = F.col("timestamp")
    if isinstance(types["timestamp"], T.StringType):
        own_day = D.own_offset_day(stamp, D.instant_from_text(stamp))
    else:
        own_day = _instant(stamp, types["timestamp"]).cast("date")
    day = _day(F.col("data_date"), types["data_date"]) if "data_date" in types else F.lit(None).cast("date")
    return df.withColumn(RECORD_DATE, F.coalesce(day, own_day))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def quarantined(checked: DataFrame) -> DataFrame:
    """Rejected rows (values that could not be coerced are null) with every rule they broke."""
    return checked.filter(F.size(ERRORS) > 0)
