"""First-by-arrival with bounded state: equal to the batch, and forgetting what the watermark has passed."""

from datetime import datetime, timedelta

from hazeline.operators.survivors import one_per_key
from hazeline.sinks.versions import VersionedTable
from hazeline.streaming.firsts import ingest_firsts, read_firsts

SCHEMA = "k string, ord bigint, at timestamp, day string"


def row(k, ord, day, hour=0):
    return (k, ord, datetime(2024, 1, 1) + timedelta(days=day, hours=hour), f"d{day}")


def test_stream_equals_batch_and_state_is_bounded(spark, tmp_path):
    """Four runs: earlier rows that come late, rows that come twice, a key of many rows; after the last one only recent keys are kept."""
    batches = [
        [row(f"a{k}", 100 + k, 0) for k in range(30)] + [row("hot", 500 + k, 0, k % 24) for k in range(50)],
        [row("a3", 5, 0, 3), row("a4", 900, 0, 4), row("hot", 1, 1)] + [row(f"b{k}", 200 + k, 1) for k in range(30)],
        [row("a3", 5, 0, 3), row("b7", 2, 1)] + [row(f"c{k}", 300 + k, 10) for k in range(5)],
        [row(f"d{k}", 400 + k, 11) for k in range(5)] + [row("c1", 3, 10)],
    ]
    table, states = VersionedTable(spark, str(tmp_path / "firsts"), "day"), []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = ingest_firsts(stream, ["k"], "ord", "at", "3 days", str(tmp_path / "firsts"), "day", str(tmp_path / "checkpoint"))
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else None)
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    got = sorted(map(tuple, read_firsts(table, ["k"], "ord").select("k", "ord", "at").collect()))
    assert got == sorted(map(tuple, one_per_key(every, ["k"], [every.ord]).select("k", "ord", "at").collect()))
    # Four entries a key (two values and its timer); 61 keys of the first days are gone.
    assert states[1] is None or states[1] >= 61
    assert states[-1] is not None and states[-1] <= 4 * 10


def test_firsts_are_aggregated_in_the_engine(spark, tmp_path):
    """Many keys are one aggregation, combined before the exchange, and not a call per key; null keys, equal rows and rows that don't precede add nothing."""
    table = VersionedTable(spark, str(tmp_path / "firsts"), "day")
    batches = [
        [row(k, 10, 0) for k in ("a", "b", None)] * 2 + [row("a", 11, 0, 5)],
        [row("a", 10, 0), row("b", 12, 0), row(None, 3, 0), row("a", 20, 1)],
        [row("a", 19, 1), row("b", 9, 1)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = ingest_firsts(stream, ["k"], "ord", "at", "3 days", str(tmp_path / "firsts"), "day", str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert [p["operatorName"] for p in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
    # One row for each key and day, and one for each that came later and precedes it.
    stored = sorted((r.k or "", r.ord, r.day) for r in table.read().collect())
    assert stored == [("", 3, "d0"), ("", 10, "d0"), ("a", 10, "d0"), ("a", 19, "d1"), ("a", 20, "d1"), ("b", 9, "d1"), ("b", 10, "d0")]
    got = sorted((r.k or "", r.ord) for r in read_firsts(table, ["k"], "ord").collect())
    assert got == [("", 3), ("a", 10), ("b", 9)]
