"""Numeric rules as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline.contracts import SENTINELS

_DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL_TEXT = r"^[+-]?(inf|infinity|nan)$"
_WHOLE_TEXT = r"^[+-]?[0-9]+(\.0+)?$"
# A single underscore between digits is a thousands mark.
_DIGIT_MARK = "(?<=[0-9])_(?=[0-9])"


def number_from_text(text: Column) -> Column:
    """Double for decimal text, null otherwise. A plain cast would also take Java forms such as ``1d``."""
    t = F.regexp_replace(F.trim(text), _DIGIT_MARK, "")
    return F.when(t.rlike(_DECIMAL_TEXT) | F.lower(t).rlike(_SPECIAL_TEXT), t.try_cast("double"))


def whole_from_text(text: Column) -> Column:
    """BIGINT for integer text (``12`` and ``12.0``), null for anything else (``12.5``)."""
    t = F.regexp_replace(F.trim(text), _DIGIT_MARK, "")
    return F.when(t.rlike(_WHOLE_TEXT), F.regexp_replace(t, r"\..*$", "").try_cast("bigint"))


def whole_from_number(number: Column) -> Column:
    """BIGINT when the number has no fraction, null otherwise (also for NaN and infinities)."""
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def without_sentinels(number: Column) -> Column:
    return F.when(~number.isin(*SENTINELS), number)


def without_negatives(number: Column) -> Column:
    return F.when(number >= 0, number)


def half_even(number: Column) -> Column:
    """Nearest whole number, ties to the even one, kept as a double so that NaN stays visible."""
    return F.bround(number, 0)


def falsy_or(first: Column, second: Column) -> Column:
    """``first`` unless it is null or zero, else ``second``."""
    return F.coalesce(F.when(first != 0, first), second)


# Adding and subtracting this rounds a double to a multiple of 2**-16.
_GRID = 1.5 * 2.0**36
_GRID_RANGE = 2.0**35
# Multiplying by this splits a double into two halves of 26 bits.
_SPLIT = 2.0**27 + 1


def _on_grid(value: Column) -> Column:
    return F.when(F.abs(value) < _GRID_RANGE, (value + _GRID) - _GRID).otherwise(value)


def _off_grid(value: Column) -> Column:
    return F.when(F.abs(value) < _GRID_RANGE, value - ((value + _GRID) - _GRID)).otherwise(0.0)


def _halves(value: Column) -> tuple[Column, Column]:
    scaled = value * _SPLIT
    high = scaled - (scaled - value)
    return high, value - high


def _quotient(coarse: Column, fine: Column, n: Column) -> Column:
    """The double nearest to (coarse + fine) / n."""

    def corrected(q: Column) -> Column:
        high, low = _halves(q["q"])
        rest = ((q["t"] - high * n) - low * n) + q["left"]
        return F.when(F.abs(q["q"]) < _GRID_RANGE, q["q"] + rest / n).otherwise(q["q"])

    total = coarse + fine
    parts = F.struct(total.alias("t"), (fine - (total - coarse)).alias("left"), (total / n).alias("q"))
    return _with(parts, corrected)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often the result refers to it."""
    return F.transform(F.array(value), use)[0]


def round_exact(value: Column, places: int = 4) -> Column:
    """Round by the exact binary value, true ties to the even digit (``round`` goes by the printed digits, half up)."""
    scale = float(10**places)

    def rounded(v: Column) -> Column:
        size, below = v["size"], v["below"]
        high, low = _halves(size)
        past_tie = (high * (2 * scale) - (below * 2 + 1)) + low * (2 * scale)
        up = F.when(past_tie > 0, 1).when(past_tie == 0, below % 2).otherwise(0)
        return (below + up) / F.lit(scale) * F.signum(v["value"])

    size = F.abs(value)
    parts = F.struct(value.alias("value"), size.alias("size"), F.floor(size * scale).alias("below"))
    return F.when(size < 2.0**52 / scale, _with(parts, rounded)).otherwise(value)


def array_mean(values: Column, places: int = 4) -> Column:
    """Mean of the non-null elements rounded to ``places``; null when there are none. No shuffle.

    Near a rounding tie the elements are summed in two parts, so the mean is the double nearest to the exact one.
    """

    scale = float(10**places)

    def exact(kept: Column) -> Column:
        coarse = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + _on_grid(x))
        fine = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + _off_grid(x))
        sums = F.struct(coarse.alias("coarse"), fine.alias("fine"))
        mean = _with(sums, lambda s: _quotient(s["coarse"], s["fine"], F.size(kept)))
        return _with(mean, lambda m: round_exact(m, places))

    def mean_of(kept: Column) -> Column:
        def rounded(s: Column) -> Column:
            part = s - F.floor(s)
            # Far from a tie a plain sum rounds to the same digits; the rest is one row in hundreds.
            plain = (F.abs(s) < 1e9) & (F.abs(part - 0.5) > 1e-3)
            return F.when(plain, (F.floor(s) + F.when(part > 0.5, 1).otherwise(0)) / F.lit(scale)).otherwise(exact(kept))

        total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.size(kept) > 0, _with(total / F.size(kept) * scale, rounded))

    return _with(F.array_compact(values), mean_of)


def group_mean(value: Column, places: int = 4) -> Column:
    """The same mean as an aggregate over exploded rows: three plain sums with partial aggregation."""
    n = F.count(value)
    mean = _quotient(F.sum(_on_grid(value)), F.sum(_off_grid(value)), n)
    return F.when(n > 0, _with(mean, lambda m: round_exact(m, places)))


def whole_milliseconds(seconds: Column) -> Column:
    """Seconds to whole milliseconds, truncated; 0 when unknown."""
    return F.coalesce((seconds * 1000).try_cast("int"), F.when(seconds.isNull(), F.lit(0)))
