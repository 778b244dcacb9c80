"""Reading JSON payloads as VARIANT, where numbers and numeric text stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.functions import text as X

NUMERIC_KINDS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")


_BARE = r'([\[:,]\s*)(-?Infinity|NaN)(?=\s*[,\]}])'


def parsed(text: Column) -> Column:
    """The text as VARIANT, null when it isn't JSON. Of equal keys the last counts. Bare NaN and Infinity, which JSON lacks, become text:
    no number field accepts them, so they reject their row and not the call."""
    quoted = F.regexp_replace(text, F.lit(_BARE), F.lit('$1"$2"'))
    retry = F.when(text.rlike("NaN|Infinity"), F.try_parse_json(quoted))
    return F.coalesce(F.try_parse_json(text), retry)


def first_of(value: Column) -> tuple[Column, Column]:
    """(first element, whether there can be none): an array's first element, a text's first character, null for what is missing or
    falsy. Any other value has no first element. Only a value that is no array with elements is looked at closer."""
    shape, element = kind(value), F.try_variant_get(value, "$[0]", "variant")
    letter = F.when((shape == "STRING") & truthy(value), F.left(F.try_variant_get(value, "$", "string"), F.lit(1)).cast("variant"))
    none = value.isNotNull() & element.isNull() & ~shape.isin("ARRAY", "STRING") & truthy(value)
    return F.coalesce(element, F.when(value.isNotNull(), letter)), F.coalesce(none, F.lit(False))


def at(payload: Column, path: str) -> Column:
    """Sub-value as VARIANT: SQL null when the path is missing, a variant null when JSON says ``null``."""
    return F.try_variant_get(payload, path, "variant")


def number_at(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "double")


def text_at(payload: Column, path: str) -> Column:
    return F.try_variant_get(payload, path, "string")


def kind(value: Column) -> Column:
    """BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, OBJECT, ARRAY, VOID; null for a missing value."""
    schema = F.schema_of_variant(value)
    name = F.substring_index(F.substring_index(schema, "<", 1), "(", 1)
    return F.when(value.isNotNull(), name)


def is_number(value_kind: Column) -> Column:
    return value_kind.isin(*NUMERIC_KINDS)


def is_object(value: Column) -> Column:
    """Whether a value is an object; null for a missing value."""
    return F.when(value.isNotNull(), F.try_variant_get(value, "$", "struct<x: variant>").isNotNull())


def truthy(value: Column) -> Column:
    """True for a value that is neither missing, null, zero, false, nor empty."""
    body = value.cast("string")
    # A zero is written with a leading 0; text may be, too.
    zero = F.when(body.rlike("^-?0") & is_number(kind(value)), F.try_variant_get(value, "$", "double") == 0)
    return F.coalesce(~body.isin("", "{}", "[]", "false") & ~F.coalesce(zero, F.lit(False)), F.lit(False))


def document_text(raw: Column) -> Column:
    """Payload text that parses as JSON; null for blank, N/A, malformed text and JSON ``null``."""
    stripped = X.null_token(raw)
    return F.when((stripped != "null") & parsed(stripped).isNotNull(), stripped)


def is_document(json_text: Column) -> Column:
    """An object or an array, judged by the first character of text known to be JSON."""
    return F.left(json_text, F.lit(1)).isin("{", "[")


def is_value(value: Column) -> Column:
    """True for what is neither missing nor a JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


def not_a_number(value: Column) -> Column:
    """True for a present value that neither is nor spells a number (a JSON null is no value)."""
    return F.try_variant_get(value, "$", "double").isNull() & F.coalesce(is_value(value), F.lit(False))


def not_numbers(payload: Column, path: str, typed: Column) -> Column:
    """True for a present value that is no list, or a list with an element that is no number.

    ``typed`` is the same value read as numbers: only where it has nulls are the elements looked at one by one.
    """
    value = at(payload, path)
    items = F.try_variant_get(payload, path, "array<variant>")
    strict = F.coalesce(F.exists(items, not_a_number), value.isNotNull())
    return F.when(typed.isNull() | F.exists(typed, lambda x: x.isNull()), strict).otherwise(False)


def any_of(tests: list[Column]) -> Column:
    """Disjunction that stops at the first true test; a null test counts as false."""
    result = F.lit(False)
    for test in reversed(tests):
        result = F.coalesce(test, F.lit(False)) | result
    return result
