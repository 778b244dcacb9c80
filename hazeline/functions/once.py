"""Evaluating costly columns once per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column], keep: Sequence[str] = ("*",)) -> DataFrame:
    """Add columns through a one-row generator.

    A filter on anything derived from them cannot move below a generator, so the optimizer never copies these costly
    expressions into the filter, where each reference would evaluate them again.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
