"""Publishing by steps: interrupted after each of them and resumed, read back, counted while written."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hazeline.plans.run import LAYERS, read_back, run_live
from hazeline.sinks.publish import Manifest, digest
from hazeline.sinks.snapshots import read_snapshot
from hazeline.sinks.tables import read_features
from hazeline.sources.cities import cities
from tests.landing import CITIES, RUN, land
from tests.test_runs import LIVE, PAST, report

STEPS = [*LAYERS[:5], "statistics", LAYERS[5], "latest", "raw_records", "daily_features"]


class Cut(RuntimeError):
    pass


def contents(spark, base):
    frames = {layer: read_snapshot(spark, base, layer, RUN.run_id) for layer in LAYERS}
    frames |= {name: spark.read.parquet(f"{base}/{name}") for name in ("latest/raw", "tables/raw_records")}
    frames["features"] = read_features(spark, f"{base}/tables/daily_features")
    return {name: sorted(str(sorted(r.asDict(True).items(), key=str)) for r in df.collect()) for name, df in frames.items()}


def test_resumed_after_each_step(spark, tmp_path, monkeypatch):
    landing = land(tmp_path / "landing", LIVE + PAST, extra_lines=["{broken"])
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    run_live(spark, landing, cities(spark, CITIES), whole, RUN)
    enter, written = Manifest._enter, []

    def stop(self, layer, seen):
        enter(self, layer, seen)
        written.append(layer)
        if layer in STEPS:
            raise Cut(layer)

    with monkeypatch.context() as patched:
        patched.setattr(Manifest, "_enter", stop)
        for step in STEPS:
            with pytest.raises(Cut, match=step):
                run_live(spark, landing, cities(spark, CITIES), cut, RUN, resume=True)
    assert written == STEPS  # none was written twice
    published = run_live(spark, landing, cities(spark, CITIES), cut, RUN, resume=True)
    assert published.exit_code == 1 and contents(spark, cut) == contents(spark, whole)
    rows = [published.summary.first().asDict(True), spark.read.parquet(f"{whole}/reports/run_id={RUN.run_id}/summary").first().asDict(True)]
    for row in rows:
        row.pop("execution_time_seconds")
        row["failed_requests"].pop("path")
    assert rows[0] == rows[1] and len(report(cut, f"run_id={RUN.run_id}", "pipeline")) == 16
    manifest = Manifest(spark, cut, RUN.run_id, resume=True)
    checks = {r.layer: (r.rows, r.stored_rows, r.complete) for r in read_back(spark, manifest, cut, RUN).collect()}
    assert set(checks) == {*LAYERS, "raw_records", "daily_features"} and all(c for _, _, c in checks.values())
    assert checks["bronze"][:2] == (9, 9) and checks["quarantine"][:2] == (2, 2) and checks["gold"][:2] == (2, 2)


def test_a_write_that_died_is_done_again(spark, tmp_path):
    """A layer without its manifest row is written again whole, whatever its folder holds."""
    rows, path = spark.range(100).withColumn("v", F.col("id") * 2), str(tmp_path / "t")
    manifest = Manifest(spark, str(tmp_path), "r")
    with pytest.raises(Cut):
        def die(df):
            df.limit(7).write.mode("overwrite").parquet(path)
            raise Cut
        manifest.step("t", rows, die)
    again = Manifest(spark, str(tmp_path), "r", resume=True)
    again.step("t", rows, lambda df: df.write.mode("overwrite").parquet(path), {"evens": F.count_if(F.col("id") % 2 == 0)})
    assert again.written == ["t"] and again.counters("t") == {"evens": 50}
    assert again.verify({"t": spark.read.parquet(path)}).first()[1:] == (100, 100, True)
    # A new attempt knows nothing of the last one.
    assert Manifest(spark, str(tmp_path), "r").done == {}


def test_damage_is_seen(spark, tmp_path):
    schema = "k string, m map<string,int>, f double"
    rows = spark.createDataFrame([("a", {"x": 1}, 0.5), ("a", {"x": 1}, 0.5), (None, None, float("nan")), ("", {}, None)], schema)
    manifest = Manifest(spark, str(tmp_path), "r")
    manifest.step("t", rows, lambda df: df.write.partitionBy("k").parquet(str(tmp_path / "t")), partitions=("k",))
    manifest.step("none", rows.limit(0), lambda df: df.write.parquet(str(tmp_path / "none")))
    stored = spark.read.parquet(str(tmp_path / "t"))
    check = lambda df: manifest.verify({"t": df}, {"t": ("k",)}).first().complete
    assert check(stored) and check(stored.repartition(3))
    assert not check(stored.dropDuplicates(["f"])) and not check(stored.withColumn("f", F.coalesce("f", F.lit(1.0)))) and not check(None)
    assert manifest.verify({"none": None, "never": None}).select("layer", "complete").collect() == [("none", True), ("never", False)]
    assert digest(rows) is not None


def test_counters_read_no_layer(spark, tmp_path, monkeypatch):
    """The summary comes from what the writes observed."""
    from hazeline.sinks import reports

    landing = land(tmp_path / "landing", LIVE)
    seen = {}
    plain = reports.observed_summary

    def kept(*args):
        seen["summary"] = plain(*args)
        return seen["summary"]

    monkeypatch.setattr(reports, "observed_summary", kept)
    run_live(spark, landing, cities(spark, CITIES), str(tmp_path / "out"), RUN)
    text = seen["summary"]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in text and "Exchange" not in text
    assert Path(tmp_path / "out/manifest").exists()
