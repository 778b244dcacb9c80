"""Dates, instants and epoch windows as column expressions (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([Tt _][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
_ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt _]00:00(:00([.,]0+)?)?[Zz]?)?$"
_EPOCH = r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
# Epoch numbers beyond this are milliseconds.
_MILLIS_FROM = 2e10


def epoch_instant(number: Column) -> Column:
    """Epoch seconds (or milliseconds when the number is large) to an instant."""
    seconds = F.when(F.abs(number) > _MILLIS_FROM, number / 1000).otherwise(number)
    return F.timestamp_micros(F.round(seconds * 1_000_000).try_cast("bigint"))


def instant_from_text(text: Column) -> Column:
    """ISO date, ISO date-time or epoch text to an instant; null when it is none of them."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(F.upper(t), "[_ ]", "T"), ",", ".")
    iso = F.regexp_replace(iso, "([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.when(t.rlike(_ISO), iso.try_cast("timestamp")).when(
        t.rlike(_EPOCH), epoch_instant(t.try_cast("double"))
    )


def day_from_text(text: Column) -> Column:
    """ISO day (also with a midnight time) or an epoch that falls on a day boundary."""
    t = F.trim(text)
    midnight = epoch_instant(t.try_cast("double"))
    return F.when(t.rlike(_ISO_DAY), F.left(t, F.lit(10)).try_cast("date")).when(
        t.rlike(_EPOCH) & (F.date_trunc("day", midnight) == midnight), midnight.cast("date")
    )


def own_offset_day(text: Column, instant: Column) -> Column:
    """Calendar day of a time stamp in the offset it was written with."""
    t = F.trim(text)
    return F.when(t.rlike(_ISO), F.left(t, F.lit(10)).try_cast("date")).otherwise(instant.cast("date"))


def day_start_epoch(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 86400


def day_end_epoch(day: Column) -> Column:
    """Last whole second of the day."""
    return day_start_epoch(day) + 86399


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def iso_instant(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
