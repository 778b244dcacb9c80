"""Versioned tables: what readers see around writes, dying writes, replays, compaction and vacuum."""

from pathlib import Path

import pytest

from hazeline.operators.upsert import merge_latest
from hazeline.sinks.versions import VersionedTable

SCHEMA = "k string, d string, v int"


def rows(df):
    return sorted(map(tuple, df.select("k", "d", "v").collect()), key=str)


def last(old, new):
    return merge_latest(old, new, ["k", "d"], "v")


def test_merge_writes_touched_partitions_only(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "d")
    assert t.read() is None and t.latest() == (-1, -1) and not t.compact() and t.vacuum() is None
    t.merge(spark.createDataFrame([("a", "d1", 1), ("b", "d2", 1), ("c", None, 1)], SCHEMA), last)
    t.merge(spark.createDataFrame([("a", "d1", 2), ("x", "d3", 1)], SCHEMA), last)
    assert rows(t.read()) == [("a", "d1", 2), ("b", "d2", 1), ("c", None, 1), ("x", "d3", 1)]
    assert sorted(map(tuple, t.parts().collect()), key=str) == [("d1", 1), ("d2", 0), ("d3", 1), (None, 0)]
    assert rows(t.read(0)) == [("a", "d1", 1), ("b", "d2", 1), ("c", None, 1)]


def test_keys_leave_with_and_without_a_day(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "d")
    t.merge(spark.createDataFrame([("a", None, 1), ("b", None, 1), ("c", "d1", 1), ("e", "d2", 1), (None, "d2", 1)], SCHEMA), last)
    gone = spark.createDataFrame([("a", None), ("c", "d1"), (None, "d2")], "k string, d string")
    t.merge(spark.createDataFrame([("n", "d5", 1)], SCHEMA), last, gone)
    assert rows(t.read()) == [("b", None, 1), ("e", "d2", 1), ("n", "d5", 1)]
    assert {r[0] for r in t.parts().collect()} == {None, "d2", "d5"}
    t.merge(spark.createDataFrame([], SCHEMA), last, spark.createDataFrame([("b", None), ("e", "d2"), ("n", "d5")], "k string, d string"))
    assert rows(t.read()) == [] and t.parts().count() == 0
    t.append(spark.createDataFrame([("z", "d1", 1)], SCHEMA))
    assert rows(t.read()) == [("z", "d1", 1)]


@pytest.mark.parametrize("dies", ["_store", "_commit"])
def test_a_write_that_dies_leaves_the_former_version(spark, tmp_path, monkeypatch, dies):
    t = VersionedTable(spark, str(tmp_path), "d")
    t.append(spark.createDataFrame([("a", "d1", 1), ("b", "d2", 1)], SCHEMA), 0)
    whole = getattr(VersionedTable, dies)

    def half(self, *args):
        if dies == "_store":  # the data stands, the commit doesn't
            whole(self, *args)
        raise InterruptedError

    monkeypatch.setattr(VersionedTable, dies, half)
    for write in (lambda: t.merge(spark.createDataFrame([("a", "d1", 9)], SCHEMA), last), lambda: t.append(spark.createDataFrame([("a", "d1", 9)], SCHEMA), 1), lambda: t.compact(0)):
        with pytest.raises(InterruptedError):
            write()
        assert rows(VersionedTable(spark, str(tmp_path), "d").read()) == [("a", "d1", 1), ("b", "d2", 1)]
    monkeypatch.undo()
    assert t.append(spark.createDataFrame([("c", "d1", 2)], SCHEMA), 1) and not t.append(spark.createDataFrame([("c", "d1", 2)], SCHEMA), 1)
    assert rows(t.read()) == [("a", "d1", 1), ("b", "d2", 1), ("c", "d1", 2)]


def test_micro_batches_leave_a_bounded_number_of_files(spark, tmp_path):
    """Twelve batches with compaction: readers see the same rows before, during and after, and files don't pile up."""
    t, expected = VersionedTable(spark, str(tmp_path), "d"), []
    for k in range(12):
        batch = [(f"k{k}", f"d{k % 3}", k), (f"l{k}", None, k)]
        expected += batch
        t.append(spark.createDataFrame(batch, SCHEMA).coalesce(1), k)
        before = t.read()  # a plan made before the compaction
        seen = rows(before)
        if t.compact(3):
            assert rows(t.read()) == seen == rows(before) == sorted(expected, key=str)
        t.vacuum(2)
    assert rows(t.read()) == sorted(expected, key=str) and t.latest()[1] == 11
    assert max(r["count"] for r in t.parts().groupBy("_part").count().collect()) <= 3
    files = [p for p in Path(tmp_path).rglob("*.parquet") if p.is_file()]
    assert len(files) <= 4 * 3 * 3 + 3


def test_reads_prune_to_the_partitions_wanted(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path), "d")
    for k in range(3):
        t.append(spark.createDataFrame([(f"k{k}", f"d{k}", k)], SCHEMA), k)
    plan = t.read().filter("d = 'd1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "d#" in plan[plan.index("PartitionFilters") :] and rows(t.read().filter("d = 'd1'")) == [("k1", "d1", 1)]
