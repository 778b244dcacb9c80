"""Compare a Spark result with DuckDB: columns by name, rows in any order, values exactly."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES.split():
        if (Path(sf_dir) / f"{name}.parquet").exists():
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def plain(value):
    """One comparable form per value; the kind stays visible, so 1 and 1.0 differ."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    if isinstance(value, datetime):
        return ("datetime", value.isoformat())
    if isinstance(value, date):
        return ("date", value.isoformat())
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, db) -> list[str]:
    """Differences as readable lines; empty when both agree."""
    result = db.execute(sql)
    expected_columns, expected = rows_of([c[0] for c in result.description], result.fetchall())
    columns, actual = rows_of(df.columns, df.collect())
    if columns != expected_columns:
        return [f"columns {columns} != {expected_columns}"]
    if actual == expected:
        return []
    only_spark, only_duck = list((actual - expected).items()), list((expected - actual).items())
    return [f"{sum(actual.values())} rows vs {sum(expected.values())}, {len(only_spark)} only in Spark, {len(only_duck)} only in SQL",
            *[f"  spark {r}" for r in sorted(only_spark, key=str)[:3]], *[f"  sql   {r}" for r in sorted(only_duck, key=str)[:3]]]
