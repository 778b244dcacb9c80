"""Landed provider calls: reading them and turning them into calls with a status and record columns.

The engine starts at payloads that a collector has put into files. One JSON line is one call, laid out as
``contracts.LANDED``. Every provider is a set of column expressions from the parsed payload to record columns and a
problem (null when the payload could be normalized); all of them run over one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.contracts import LANDED, MEASURES
from hazeline.functions import numbers as N
from hazeline.functions import payload as J
from hazeline.functions.once import computed_once
from hazeline.operators.bronze import FAILED, UNKNOWN, call_error, call_status
from hazeline.operators.standardize import Run
from hazeline.sources import aqicn, openmeteo, openweather
from hazeline.sources.cities import with_city


@dataclass(frozen=True)
class Reader:
    """How one provider's payload becomes record columns (``timestamp`` text, ``status``, measures as VARIANT) and a
    problem text, for live and historical calls.

    ``documents`` are typed parts of a historical payload by path, ``series`` the arrays in them that are averaged.
    """

    live: Callable[[Column, Column], tuple[dict[str, Column], Column]]
    history: Callable[..., tuple[dict[str, Column], Column]] | None = None
    documents: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    series: Callable[[dict[str, Column]], dict[str, Column]] = lambda documents: {}


READERS: dict[str, Reader] = {
    "openweather": Reader(openweather.live, openweather.history, openweather.DOCUMENTS, openweather.series),
    "openmeteo": Reader(openmeteo.live, openmeteo.history, openmeteo.DOCUMENTS, openmeteo.series),
    "aqicn": Reader(aqicn.live),
}
RECORD_COLUMNS = ["timestamp", "record_status", *MEASURES]


#: Folders of a partitioned landing, outermost first.
LANDED_FOLDERS = ["landed_run", "data_date", "source"]


def write_landed(calls: DataFrame, path: str, landed_run: str) -> None:
    """Calls as JSON lines in folders by landing run, day and source; landing a run again replaces its folders only."""
    rows = calls.withColumn("landed_run", F.lit(landed_run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LANDED_FOLDERS).json(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines with a fixed schema; unreadable lines stay, with their text in ``malformed``.

    In a landing that is partitioned by ``LANDED_FOLDERS`` these three come from the folder names, also for unreadable lines, and filters on
    them prune folders. In a flat one ``landed_run`` is null.
    """
    schema = T.StructType([*LANDED.fields, T.StructField("landed_run", T.StringType())])
    return spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="malformed")


def of_run(landed: DataFrame, landed_run: str | None) -> DataFrame:
    return landed if landed_run is None else landed.filter(F.col("landed_run") == landed_run)


def of_window(landed: DataFrame, wanted: Column) -> DataFrame:
    """The wanted calls. Unreadable lines of a flat landing have no day; they stay in, so that bronze drops no call."""
    return landed.filter(wanted | (F.col("landed_run").isNull() & F.col("malformed").isNotNull()))


def _documents(source: str, reader: Reader) -> dict[str, Column]:
    return {name: F.col(f"_{source}_{name}") for name in reader.documents}


def _by_source(cases: Sequence[tuple[str, Column | None, Column | None]], empty: Column) -> Column:
    """CASE over the sources, then over live and historical, so a row evaluates its own provider only."""
    past = F.col("data_date").isNotNull()
    result = F.lit(None)
    for source, live, history in reversed(cases):
        value = F.when(past, empty if history is None else history).otherwise(empty if live is None else live)
        result = F.when(F.col("source") == source, value).otherwise(result)
    return result


def to_calls(landed: DataFrame, run: Run, readers: Mapping[str, Reader] = READERS) -> DataFrame:
    """Landed columns, the record columns, ``status`` and ``error``. Narrow: projections over one scan.

    The payload is parsed once, typed parts and their means are read once from it, and the columns refer to those. A
    narrower set of ``readers`` gives a smaller plan where the sources are known. A call whose
    status is failed has no record, whatever its record columns hold.
    """
    full = landed if "malformed" in landed.columns else landed.withColumn("malformed", F.lit(None).cast("string"))
    parsed = computed_once(full, {"_p": J.parsed(F.col("payload"))})
    past = F.col("data_date").isNotNull()
    typed, means = {}, {}
    for source, reader in readers.items():
        mine = (F.col("source") == source) & past
        for name, (path, type_) in reader.documents.items():
            typed[f"_{source}_{name}"] = F.when(mine, F.try_variant_get("_p", path, type_))
        arrays = reader.series(_documents(source, reader))
        if arrays:
            means[f"_{source}_means"] = F.when(mine, F.transform(F.array(*arrays.values()), lambda a: N.array_mean(a)))
    read = parsed
    for columns in (typed, means):
        read = computed_once(read, columns) if columns else read
    now, day = F.lit(run.text), F.date_format("data_date", "yyyy-MM-dd")
    modes = []
    for source, reader in readers.items():
        live = reader.live(F.col("_p"), now)
        if reader.history is None:
            modes.append((source, live, reader.live(F.col("_p"), day)))
            continue
        documents = _documents(source, reader)
        averages = {c: F.col(f"_{source}_means")[i] for i, c in enumerate(reader.series(documents))}
        modes.append((source, live, reader.history(F.col("_p"), documents, averages, day)))

    def column(name: str, empty: Column) -> Column:
        return _by_source([(s, live[0].get(name), past_[0].get(name)) for s, live, past_ in modes], empty)

    unread = F.col("malformed").isNotNull() | F.col("source").isNull()
    problem = (
        F.when(unread, F.lit("unreadable call"))
        .when(~F.col("source").isin(*readers), F.lit("unknown source"))
        .when(F.col("_p").isNull(), F.lit("payload is not JSON"))
        .otherwise(_by_source([(s, live[1], past_[1]) for s, live, past_ in modes], F.lit(None).cast("string")))
    )
    variant = F.lit(None).cast("variant")
    known = read.select(
        *[c for c in landed.columns if c not in ("malformed", "source", "city", "payload")],
        F.when(unread, UNKNOWN).otherwise(F.col("source")).alias("source"),
        F.when(unread, UNKNOWN).otherwise(F.coalesce("city", F.lit(UNKNOWN))).alias("city"),
        F.when(unread, "{}").otherwise(F.col("payload")).alias("raw_payload"),
        column("timestamp", F.lit(None).cast("string")).alias("timestamp"),
        column("status", F.lit(None).cast("string")).alias("record_status"),
        *[column(m, variant).alias(m) for m in MEASURES],
        problem.alias("_problem"),
    )
    return known.withColumn("status", call_status(F.col("_problem"), F.col("errors"))).withColumn(
        "error", call_error(F.col("_problem"), F.col("errors"))
    ).drop("_problem")


def to_records(calls: DataFrame, dim: DataFrame) -> DataFrame:
    """Source records of the calls that could be normalized, with city attributes attached.

    A record has its own status, which is not that of its call.
    """
    read = calls.filter(F.col("status") != FAILED).select(
        "ord", "city", "source", "data_date", "response_time_seconds", "raw_payload",
        *[c for c in RECORD_COLUMNS if c != "record_status"], F.col("record_status").alias("status"),
    )
    return with_city(read, dim)
