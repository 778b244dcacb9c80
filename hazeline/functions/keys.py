"""Row keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(columns: Sequence[str], extra: dict[str, Column] | None = None) -> Column:
    """JSON object of the columns in name order; nulls are written, so absent and null differ from text."""
    parts = {name: F.col(f"`{name}`") for name in columns} | (extra or {})
    return F.to_json(F.struct(*[parts[n].alias(n) for n in sorted(parts)]), {"ignoreNullFields": "false"})


def record_key(columns: Sequence[str], extra: dict[str, Column] | None = None) -> Column:
    """SHA-1 over the canonical JSON of a row."""
    return F.sha1(canonical_json(columns, extra).cast("binary"))
