"""First-by-arrival over a stream with bounded state: a key keeps the first row seen of each window of event time, and forgets it once the watermark has passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazeline.operators.survivors import one_per_key
from hazeline.sinks.versions import VersionedTable

#: State is kept in RocksDB, so that it may be larger than memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Length of the windows of event time in which a key has a state.
SPAN = "1 day"
_WINDOW, _BATCH, _FIRST = "_window", "_batch", "_first"


def first_rows(stream: DataFrame, keys: Sequence[str], ord: str, event_time: str, lateness: str, span: str = SPAN) -> DataFrame:
    """The rows that precede all rows of their key and window of event time seen so far, as an update stream; the lowest of a key is its first by arrival.

    State is one row a key and window. It is dropped when no row of the window can come any more: ``lateness`` after its end. Rows later than that are
    dropped, as in any operator with a watermark. A key whose events lie in several windows gives a first row in each. Rows are combined before the exchange.
    """
    # The time of the micro-batch, equal when it is replayed, tells rows that came now from those that were there.
    dealt = stream.withWatermark(event_time, lateness).withColumn(_BATCH, F.current_timestamp())
    row = F.struct(*stream.columns, _BATCH)
    firsts = dealt.groupBy(*keys, F.window(event_time, span).alias(_WINDOW)).agg(F.min_by(row, F.struct(ord, _BATCH)).alias(_FIRST))
    return firsts.filter(F.col(f"{_FIRST}.{_BATCH}") == F.current_timestamp()).select(*[F.col(f"{_FIRST}.`{c}`") for c in stream.columns])


def ingest_firsts(
    stream: DataFrame, keys: Sequence[str], ord: str, event_time: str, lateness: str, path: str, partition: str, checkpoint: str,
) -> StreamingQuery:
    """Process what has landed, add the preceding rows to the versioned table at path, then stop. A replayed batch adds nothing."""
    spark = stream.sparkSession
    spark.conf.set(*STATE_STORE)

    def apply(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(spark, path, partition).append(batch, batch_id)

    found = first_rows(stream, keys, ord, event_time, lateness)
    return found.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_firsts(table: VersionedTable, keys: Sequence[str], ord: str) -> DataFrame:
    """One row a key: of the stored rows of a key the one with the lowest order."""
    return one_per_key(table.read(), keys, [F.col(ord)])
