"""Stamp cleaned records with run identity, versions, timings and lineage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.contracts import API_VERSIONS, HISTORY_ENDPOINT, PIPELINE_VERSION, SILVER_LINEAGE
from hazeline.functions import numbers as N
from hazeline.functions import text as X


@dataclass(frozen=True)
class Run:
    """Identity and clock of one run; a parameter everywhere, so a rerun gives the same rows."""

    run_id: str
    at: datetime

    @classmethod
    def now(cls) -> Run:
        at = datetime.now(timezone.utc)
        return cls(f"{at:%Y%m%d_%H%M%S}_{uuid4().hex[:8]}", at)

    @property
    def instant(self) -> Column:
        return F.timestamp_micros(F.lit(int(self.at.replace(tzinfo=self.at.tzinfo or timezone.utc).timestamp() * 1_000_000)))

    @property
    def text(self) -> str:
        return self.at.replace(tzinfo=self.at.tzinfo or timezone.utc).astimezone(timezone.utc).isoformat()


def api_version(source: Column, endpoint: Column | None = None) -> Column:
    """Version by source; weather history calls of the first source carry their own version."""
    versions = F.create_map(*[F.lit(x) for pair in API_VERSIONS.items() for x in pair])
    by_source = F.try_element_at(versions, source)
    if endpoint is None:
        return by_source
    history = F.exists(endpoint, lambda e: e.contains(HISTORY_ENDPOINT))
    return F.when((source == "openweather") & F.coalesce(history, F.lit(False)), API_VERSIONS["openweather_history"]).otherwise(by_source)


def endpoint_list(df: DataFrame, name: str = "endpoint") -> Column:
    """The endpoint column as a list: text becomes a one-element list, an absent column is null."""
    field = next((f for f in df.schema.fields if f.name == name), None)
    if field is None or isinstance(field.dataType, T.NullType):
        return F.lit(None).cast("array<string>")
    if isinstance(field.dataType, T.ArrayType):
        return F.col(name).cast("array<string>")
    return F.when(X.null_token(F.col(name)).isNotNull(), F.array(F.col(name)))


def standardize(df: DataFrame, run: Run) -> DataFrame:
    """Replace any earlier stamps; narrow, so it fuses with cleaning and validation into one stage."""
    endpoint = endpoint_list(df)
    seconds = F.col("response_time_seconds")
    stamped = df.withColumns({
        "endpoint": endpoint,
        "run_id": F.lit(run.run_id),
        "pipeline_version": F.lit(PIPELINE_VERSION),
        "api_version": api_version(F.col("source"), endpoint),
        "retrieved_at": run.instant,
        "response_time_ms": N.whole_milliseconds(seconds),
    })
    parts = {
        "source_api": F.col("source"),
        **{n: F.col(n) for n in SILVER_LINEAGE.fieldNames() if n != "source_api"},
    }
    return stamped.withColumn("lineage", F.struct(*[parts[n].alias(n) for n in SILVER_LINEAGE.fieldNames()]))
