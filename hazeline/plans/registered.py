"""Registered queries: each runs an operator over whole driver tables. ``oracles`` holds the matching SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.contracts import MEASURES, SILVER_COLUMNS
from hazeline.functions import keys, numbers, payload, text, times
from hazeline.operators import bronze as B
from hazeline.operators import drift as D
from hazeline.operators import features, fuse, metrics, standardize, survivors, upsert, validate
from hazeline.operators.clean import clean
from hazeline.operators.statistics import column_statistics, merged_counts, value_counts
from hazeline.plans.run import checked_records, publish_layers, read_back
from hazeline.plans.stand_ins import RUN, calls, city_dim, dated, landed, measured, obs, table
from hazeline.session import shared_folder
from hazeline.operators.standardize import Run
from hazeline.sinks import reports, snapshots, tables
from hazeline.sinks.publish import Manifest
from hazeline.sinks.versions import VersionedTable, read_versioned
from hazeline.streaming.firsts import ingest_firsts, read_firsts
from hazeline.sources import cities, spine
from hazeline.sources.landed import READERS, to_calls, to_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _day_text(column: str):
    return times.iso_day(F.col(column)).alias(column)


# --- survivorship -------------------------------------------------------------------------------------------------


@registered
def fuse_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    winners = fuse.fuse_winners(dated(obs(spark, sf_dir)))
    return winners.select(
        "city", "record_date", "ord", F.lit(fuse.MERGED).alias("source"), F.col("source").alias("first_source"),
        "temperature", "humidity", "pm25", "aqi", "co_text", "response_time_seconds",
    )


@registered
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd"))
    return survivors.first_by_arrival(o).select("ord", "city", "data_date", "timestamp", "source", "value")


@registered
def dedup_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural duplicates of (order, line), first by ship date and then by every other column."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    kept = survivors.one_per_key(lines, ["l_orderkey", "l_linenumber"], [F.col(c) for c in order])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", _day_text("l_shipdate"))


@registered
def gold_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full fusion, with the whole lineage of every group as lists of its narrow columns in arrival order."""
    silver = dated(obs(spark, sf_dir)).withColumn("endpoint", F.array(F.col("source")))
    gold = fuse.fuse(silver.drop("ts", "value", "raw_payload")).select("city", "data_date", "source", "status", "endpoint", "temperature", "lineage_records")
    lists = fuse.lineage_lists(
        silver.select("city", F.col("record_date").alias("day"), "ord", "source", F.array_join("endpoint", "+").alias("endpoint"), F.date_format("data_date", "yyyyMMdd").alias("data_date")),
        ["source", "endpoint", "data_date"], ["city", "day"],
    ).withColumnsRenamed({"source": "sources", "endpoint": "endpoints", "data_date": "days"})
    both = gold.join(lists.withColumnRenamed("city", "_city"), (F.col("city") == F.col("_city")) & (F.col("data_date") == F.col("day")))
    return both.select(
        "city", _day_text("data_date"), "source", "status", F.array_join("endpoint", ",").alias("endpoint"), "temperature",
        F.col("lineage_records").cast("int").alias("records"), F.array_join("sources", ",").alias("sources"), F.array_join("endpoints", ",").alias("endpoints"),
        F.array_join("days", ",", "-").alias("days"), F.lit(fuse.MERGED).alias("source_api"), F.date_format("data_date", "yyyy-MM-dd").alias("lineage_date"),
    )


@registered
def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage as it is stored: one row for each source record of a fused day."""
    silver = dated(obs(spark, sf_dir)).withColumn("endpoint", F.array(F.col("source")))
    rows = fuse.lineage_rows(silver, ["temperature", "status", "response_time_seconds"])
    return rows.select("source_api", "city", _day_text("data_date"), "ord", "source", F.array_join("endpoint", ",").alias("endpoint"), "source_record.*")


@registered
def lineage_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage read in pages of at most 500 records, of three groups that own a third of the rows each."""
    rows = fuse.gather(obs(spark, sf_dir), ["city"], ["source"], "ord", 500)
    return rows.select(
        "source", "slice", F.size("items").alias("n"), F.element_at("items", 1)["city"].alias("first_city"),
        F.element_at("items", -1)["city"].alias("last_city"),
        F.array_join("items.city", ",").alias("cities"),
    )


@registered
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and pending orders merged into the finished ones; the latest date of a customer and priority wins."""
    o = table(spark, sf_dir, "orders")
    merged = upsert.merge_latest(
        o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey"
    )
    return merged.select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", _day_text("o_orderdate"), "o_totalprice")


@registered
def upsert_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers replaced by rows built from their orders, the last order winning."""
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.lit("customer").alias("origin"))
    incoming = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("amount"), F.lit("orders").alias("origin"), "o_orderkey"
    )
    target = target.withColumn("o_orderkey", F.lit(None).cast("bigint"))
    return upsert.merge_by_key(target, incoming, ["key"], "o_orderkey").select("key", "amount", "origin", "o_orderkey")


@registered
def record_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        _day_text("o_orderdate"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    key = keys.record_key(o.columns, {"run_id": F.lit(RUN.run_id)})
    return o.select("o_orderkey", key.alias("record_key"))


# --- dimensions and spine -----------------------------------------------------------------------------------------


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("position"), F.col("n_name").alias("city"),
        (F.col("n_nationkey") * 3.0).alias("latitude"), (F.col("n_nationkey") * 7.0).alias("longitude"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("L"), F.col("n_nationkey").cast("string"))).alias("location_id"),
        "n_nationkey", "n_regionkey",
    )


@registered
def dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with nation and region attributes and the two-step location id."""
    nation, region = _nations(spark, sf_dir), table(spark, sf_dir, "region")
    ids = nation.select(
        F.col("city").alias("key"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("location_id")
    ).filter("n_nationkey % 3 <> 0").unionByName(
        nation.filter("n_nationkey % 5 <> 0").select(
            F.concat(F.lit("KEY_"), text.setting_key(F.col("city"))).alias("key"),
            F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("location_id"),
        )
    )
    dim = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "city", F.col("r_name").alias("country"), "latitude", "longitude"
    )
    exact = cities.with_location_id(dim, ids, "city").withColumnRenamed("location_id", "exact_id")
    # The second lookup goes by the normalized name.
    full = cities.with_location_id(exact.withColumn("name", F.concat(F.lit("key "), F.col("city"))), ids, "name")
    o = obs(spark, sf_dir).select("ord", F.concat(F.lit("NATION_"), F.col("nation_id").cast("string")).alias("city"))
    return cities.with_city(o, full, ["country", "latitude", "longitude", "location_id", "exact_id"])


@registered
def map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location ids from one JSON object per part, the last part of a name winning."""
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))
    mapping = F.concat(
        F.lit('{"'), name, F.lit('": "'), F.col("p_brand"), F.lit('", "'), F.col("p_type"), F.lit('": null, "  ": "x", "'),
        F.col("p_name"), F.lit('-b": "  "}'),
    )
    broken = F.when(F.col("p_partkey") % 10 == 9, F.lit("not json")).otherwise(mapping)
    return cities.location_ids(part.select("p_partkey", broken.alias("mapping")), order="p_partkey")


@registered
def city_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("(é "), F.col("p_name"), F.lit(" -- "), F.col("p_brand"), F.lit(")"))
    named = part.select(text.setting_key(raw).alias("setting_key"), text.city_key(raw).alias("city_key"))
    return named.groupBy("setting_key", "city_key").agg(F.count(F.lit(1)).alias("n"))


@registered
def live_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.live_spine(city_dim(spark, sf_dir)).select("ord", "city", "source", "data_date")


def _history(spark: SparkSession, sf_dir: str, dim: DataFrame, slots: int) -> DataFrame:
    days = table(spark, sf_dir, "events").agg(
        F.min(F.col("ts").cast("date")).alias("first"), F.max(F.col("ts").cast("date")).alias("last")
    )
    return spine.history_spine(dim, days.select("first").scalar(), days.select("last").scalar(), slots)


@registered
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, _nations(spark, sf_dir), 25)


@registered
def landing_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City days for which no event of a source has landed."""
    have = obs(spark, sf_dir).select("city", "source", F.col("ts").cast("date").alias("data_date"))
    return spine.gaps(_history(spark, sf_dir, city_dim(spark, sf_dir), 1_000_000_000), have).select("city", "source", "data_date")


@registered
def planned_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _nations(spark, sf_dir)
    both = spine.live_spine(dim).unionByName(_history(spark, sf_dir, dim, 25))
    full = cities.with_city(both, dim, ["latitude", "longitude", "location_id"])
    r = spine.planned_requests(full, weather_history=True)
    return r.select(
        "ord", "city", "source", "data_date", F.array_join("requests.label", ",").alias("labels"),
        F.array_join("requests.url", ",").alias("urls"),
        F.array_join(F.transform("requests", lambda q: F.concat_ws("/", q["params"]["start"], q["params"]["end"], q["params"]["start_date"], q["params"]["id"])), ",").alias("window"),
    )


@registered
def epoch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", times.day_start_epoch(F.col("day")).alias("start"), times.day_end_epoch(F.col("day")).alias("end"))


# --- payloads -----------------------------------------------------------------------------------------------------


@registered
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("p"))
    return e.select(
        "event_id", payload.number_at(F.col("p"), "$.k").alias("k"), payload.kind(payload.at(F.col("p"), "$.k")).alias("kind"),
        payload.at(F.col("p"), "$.missing").isNull().alias("missing"),
    )


@registered
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    raw = F.when(F.col("ord") % 37 == 0, F.lit(" N/a ")).when(F.col("ord") % 41 == 0, F.lit(" [1, 2] ")).when(
        F.col("ord") % 43 == 0, F.lit("null")).when(F.col("ord") % 47 == 0, F.lit('{"a": 1, "a": [2]}')).when(
        F.col("ord") % 53 == 0, F.lit('{"a": NaN, "b": [-Infinity]}')).otherwise(F.col("raw_payload"))
    document = payload.document_text(raw)
    return o.select("ord", document.alias("document"), (document.isNotNull() & ~payload.is_document(document)).alias("rejected"))


def _records(spark: SparkSession, sf_dir: str, source: str, past: bool) -> DataFrame:
    """Records of one provider with plain numbers in place of VARIANT."""
    read = to_calls(landed(spark, sf_dir, source, past), RUN, {source: READERS[source]})
    rows = to_records(read, city_dim(spark, sf_dir))
    return rows.select(
        "ord", "city", "country", "latitude", "timestamp", "status", _day_text("data_date"),
        *[payload.number_at(F.col(m), "$").alias(m) for m in MEASURES],
    )


@registered
def openweather_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "openweather", False)


@registered
def openweather_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "openweather", True)


@registered
def openmeteo_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "openmeteo", False)


@registered
def openmeteo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "openmeteo", True)


@registered
def aqicn_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "aqicn", False)


@registered
def landed_to_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed calls of two providers through every stage to fused rows."""
    both = landed(spark, sf_dir, "openmeteo", True).withColumn("ord", F.col("ord") * 2 + 1).unionByName(
        landed(spark, sf_dir, "openweather", True).withColumn("ord", F.col("ord") * 2)
    )
    readers = {source: READERS[source] for source in ("openweather", "openmeteo")}
    records = to_records(to_calls(both, RUN, readers), city_dim(spark, sf_dir))
    # As in a run, the silver layer is written once and fusion reads it back.
    base = _scratch(spark, "landed_to_gold")
    snapshots.write_snapshot(validate.accepted(checked_records(records, RUN)), base, "silver", RUN.run_id)
    silver = snapshots.read_snapshot(spark, base, "silver", RUN.run_id)
    silver = silver.select("ord", *SILVER_COLUMNS, validate.RECORD_DATE)
    gold = fuse.fuse(silver, include_payload=False)
    sources = fuse.lineage_lists(silver, ["source"]).select(F.col("city").alias("_city"), F.col(validate.RECORD_DATE).alias("_day"), F.col("source").alias("sources"))
    return gold.join(sources, (F.col("city") == F.col("_city")) & (F.col("data_date") == F.col("_day"))).select(
        "city", _day_text("data_date"), "source", "temperature", "humidity", "aqi", "pm25", "no", "api_version",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.array_join("sources", ",").alias("sources"),
    )


@registered
def array_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double") * 1_000_000).cast("bigint").alias("first"),
        F.get(F.array().cast("array<double>"), F.lit(0)).alias("empty"),
    )


@registered
def array_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the embedding components in thousandths, negative ones left out."""
    e = table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.when(x >= 0, F.round(x.cast("double") * 1000)))
    return e.select("vec_id", numbers.array_mean(whole).alias("mean"), numbers.array_mean(F.array().cast("array<double>")).alias("empty"))


@registered
def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return e.groupBy("user_id", "day").agg(numbers.group_mean(F.col("value")).alias("mean"))


# --- calls --------------------------------------------------------------------------------------------------------


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    problem, errors = F.col("problem"), F.col("errors")
    return c.withColumn("status", B.call_status(problem, errors)).withColumn("error", B.call_error(problem, errors))


@registered
def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("ord", "status", "error")


@registered
def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.bronze(_calls(spark, sf_dir), RUN)
    return rows.withColumn("endpoint", F.array_join("endpoint", ",")).withColumn("retrieved_at", times.iso_instant(F.col("retrieved_at")))


@registered
def failed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("ord") % 3 != 0, F.col("error")).otherwise(F.when(F.col("ord") % 2 == 0, F.lit("")))
    return B.failed_requests(_calls(spark, sf_dir).withColumn("error", blank))


@registered
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.call_log(_calls(spark, sf_dir))


@registered
def api_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.api_summary(_calls(spark, sf_dir))


# --- cleaning and validation --------------------------------------------------------------------------------------


@registered
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).select("ord", F.concat(F.lit("\t"), F.col("co_text"), F.lit("\n")).alias("co_text"), "source")
    return clean(o)


@registered
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels and negatives count in numbers of pollutants only: not in text, not in other columns."""
    o = obs(spark, sf_dir).select(
        "ord", "pm25", F.col("pm25").alias("temperature"), F.col("pm25").cast("string").alias("co"),
        F.when(F.col("ord") % 5 == 0, F.lit(-999)).otherwise((F.col("ord") % 9 - 4).cast("int")).alias("no2"),
    )
    return clean(o).select("ord", "pm25", "temperature", F.col("co").cast("double").alias("co"), "no2")


@registered
def aqi_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = obs(spark, sf_dir).select("ord", (F.col("aqi") - 1).alias("aqi"))
    return clean(shifted).select("ord", F.col("aqi").cast("bigint").alias("aqi"))


@registered
def falsy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.when(F.col("ord") % 3 == 0, F.lit(0.0)).when(F.col("ord") % 3 == 1, F.col("humidity"))
    three = F.when(F.col("ord") % 4 != 0, F.col("value") + 1)
    return obs(spark, sf_dir).select("ord", numbers.falsy_or(hour, three).alias("rain"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = validate.with_record_date(clean(measured(spark, sf_dir), keep=("ord",)))
    return validate.check(standardize.standardize(records, RUN), keep=("ord", validate.RECORD_DATE))


@registered
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.accepted(_checked(spark, sf_dir))
    return rows.select("ord", "city", "country", "latitude", "temperature", "humidity", "pm25", "aqi", "co", "raw_payload", "record_date")


@registered
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.quarantined(_checked(spark, sf_dir))
    return rows.select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@registered
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps, with a history endpoint on some calls of every source and response times missing on some."""
    past = F.col("ord") % 4 == 0
    o = obs(spark, sf_dir).select(
        "ord", "city", "source",
        F.when(past, F.array(F.lit("https://history.openweathermap.org/data/3.0/history/result"), F.lit("x"))).when(
            F.col("ord") % 4 == 1, F.array(F.lit("y"))).alias("endpoint"),
        F.when(F.col("ord") % 9 != 0, F.col("response_time_seconds")).alias("response_time_seconds"),
    )
    s = standardize.standardize(o, RUN)
    return s.select(
        "ord", "run_id", "pipeline_version", "api_version", "response_time_ms", times.iso_instant(F.col("retrieved_at")).alias("retrieved_at"),
    )


@registered
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage structure of single records."""
    o = obs(spark, sf_dir).select("ord", "city", "source", F.array("source", "city").alias("endpoint"), "response_time_seconds")
    s = standardize.standardize(o, RUN).select("ord", "lineage.*")
    return s.withColumn("endpoint", F.array_join("endpoint", ",")).withColumn("retrieved_at", times.iso_instant(F.col("retrieved_at")))


@registered
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = fuse.fuse_winners(dated(obs(spark, sf_dir)))
    fields = gold.withColumn("pm25", F.when(F.col("pm25") != -9999, F.col("pm25"))).withColumn("rain", F.lit(None).cast("double"))
    return metrics.missing_values(fields, ["temperature", "humidity", "pm25", "aqi", "rain"])


@registered
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _calls(spark, sf_dir)
    source = measured(spark, sf_dir).filter(F.col("status") != B.FAILED).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))
    records = validate.with_record_date(clean(survivors.first_by_arrival(source), keep=("ord",)))
    checked = validate.check(standardize.standardize(records, RUN), keep=("ord", validate.RECORD_DATE))
    return metrics.run_counters(c, F.col("status") != B.FAILED, checked, F.size(validate.ERRORS) == 0)


# --- statistics and drift -----------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under monitored names; NaN and nulls count as missing."""
    nan = F.lit(float("nan"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("temperature"),
        F.col("l_extendedprice").alias("humidity"),
        F.when(F.col("l_discount") > 0.08, nan).when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("aqi"),
        F.lit(0.0).alias("pressure"),
        "l_shipdate",
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = _lines(spark, sf_dir)
    later = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    return lines.filter(later).withColumn("humidity", F.col("humidity") * 1.25), lines.filter(~later)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@registered
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(column_statistics(_lines(spark, sf_dir), ["temperature", "humidity", "aqi", "pressure"]))


@registered
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _halves(spark, sf_dir)
    return _rounded(D.drift(current, previous, {"temperature": 5.0, "humidity": 10.0, "aqi": 10.0, "pressure": 10.0}))


@registered
def drift_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _halves(spark, sf_dir)
    return D.drift_detected(D.mean_drift(current, previous))


@registered
def drift_all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, previous = _halves(spark, sf_dir)
    return _rounded(D.drift_all_statistics(current, previous, {"temperature": 5.0, "humidity": 10.0, "pressure": 10.0}))


@registered
def drift_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift against an earlier run's stored snapshot; a run that left none has nothing to compare."""
    current, previous = _halves(spark, sf_dir)
    base = _scratch(spark, "drift")
    snapshots.write_snapshot(previous, base, "gold", "earlier")
    stored, absent = (snapshots.read_snapshot(spark, base, "gold", run_id) for run_id in ("earlier", "never"))
    limits = {"temperature": 5.0, "humidity": 10.0, "aqi": 10.0, "pressure": 10.0}
    compared = D.drift_detected(D.drift(current, stored, limits)).withColumn("against", F.lit("stored"))
    return compared.unionByName(D.drift_detected(D.drift(current, absent, limits)).withColumn("against", F.lit("absent")))


@registered
def unreadable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of one provider, some of whose lines could not be read: those keep a placeholder in bronze."""
    lines = landed(spark, sf_dir, "aqicn", False)
    broken = F.col("ord") % 11 == 0
    lines = lines.select(*[F.when(~broken, F.col(c)).alias(c) if c in ("source", "city", "payload") else c for c in lines.columns], F.when(broken, F.lit("{cut")).alias("malformed"))
    rows = B.bronze(to_calls(lines, RUN, {"aqicn": READERS["aqicn"]}), RUN)
    return rows.groupBy("source", "status", (F.col("city") == "unknown").alias("no_city"), (F.col("raw_payload") == "{}").alias("no_payload"), F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("rows"))


@registered
def location_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location ids from settings, with single overrides that come after them."""
    part = table(spark, sf_dir, "part")
    settings = part.select("p_partkey", F.concat(F.lit('{"'), F.col("p_name"), F.lit('": "'), F.col("p_brand"), F.lit('"}')).alias("mapping"))
    overrides = part.groupBy("p_name").agg(F.min("p_type").alias("type")).select(
        F.col("p_name").alias("name"), F.when(F.length("p_name") % 2 == 0, F.concat(F.lit(" "), F.col("type"))).otherwise("").alias("location_id")
    )
    return cities.location_ids(settings, order="p_partkey", overrides=overrides)


@registered
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by records that lack what every record must have."""
    rows = measured(spark, sf_dir)
    for k, column in ((3, "city"), (4, "source"), (5, "timestamp"), (7, "latitude")):
        rows = rows.withColumn(column, F.when(F.col("ord") % (k * 10) != 0, F.col(column)))
    rows = validate.with_record_date(clean(rows, keep=("ord",)))
    checked = validate.check(standardize.standardize(rows, RUN), keep=("ord",))
    broken = checked.select(F.explode("errors").alias("rule")).filter("rule LIKE '%:required'")
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@registered
def drift_no_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier dataset without rows compares nothing."""
    current, previous = _halves(spark, sf_dir)
    return D.drift_detected(D.drift(current, previous.filter(F.col("temperature") < 0)))


# --- features and outputs -----------------------------------------------------------------------------------------


@registered
def feature_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    return features.project_features(o).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@registered
def coerce_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad numbers and instants become null and the row stays."""
    o = obs(spark, sf_dir).select(
        "city", F.col("co_text").alias("co"), F.col("humidity").cast("string").alias("humidity"),
        F.when(F.col("ord") % 6 == 0, F.lit("someday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.date_format("data_date", "yyyy-MM-dd").alias("data_date"), F.col("ord").alias("run_id"), F.array("source").alias("endpoint"),
    )
    c = features.coerce_features(o)
    return c.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).withColumn("data_date", F.date_format("data_date", "yyyy-MM-dd HH:mm:ss"))


@registered
def union_sorted_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_name", "name").withColumnRenamed("c_nationkey", "nationkey")
    supplier = table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name").withColumnRenamed("s_nationkey", "nationkey")
    return snapshots.union_sorted([customer, supplier])


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@registered
def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of two runs upserted into the stored raw table, the first run twice, and read back."""
    path, later = _scratch(spark, "raw_table"), Run("20240201_000000_00000001", RUN.at)
    rows = B.bronze(_calls(spark, sf_dir), RUN)
    for run_, part in ((RUN, rows), (later, B.bronze(_calls(spark, sf_dir).filter(F.col("source") == "aqicn"), later)), (RUN, rows)):
        tables.upsert_raw(part, path, run_.run_id, run_.at)
    return spark.read.parquet(path).groupBy("run_id", "source", "status").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("record_key").alias("keys"))


@registered
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders merged twice into a table partitioned by a day that some rows lack; the latest version of a key wins."""
    path = _scratch(spark, "feature_table")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("city"), F.when(F.col("o_custkey") % 7 != 0, F.to_date(F.concat(F.lit("2024-01-"), F.lpad((F.col("o_custkey") % 20 + 1).cast("string"), 2, "0")))).alias("data_date"),
        F.col("o_orderkey").alias("retrieved_at"), F.col("o_orderstatus").alias("status"),
    )
    for part in (o.filter("status = 'F'"), o.filter("status <> 'F' AND city % 3 <> 0")):
        VersionedTable(spark, path, "data_date").merge(part, lambda old, new: upsert.merge_latest(old, new, ["city", "data_date"]))
    return read_versioned(spark, path, "data_date").select("city", _day_text("data_date"), "retrieved_at", "status")


@registered
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality report of one run over all calls, flattened: unknown sources are folded, failures counted in full."""
    c = _calls(spark, sf_dir).withColumn("source", F.when(F.col("ord") % 10 == 0, F.concat(F.lit("other"), F.col("ord").cast("string"))).otherwise(F.col("source")))
    gold = fuse.fuse_winners(dated(obs(spark, sf_dir)))
    monitored = gold.select(*[F.col(m) if m in ("temperature", "humidity", "aqi") else F.lit(None if m == "rain" else 1.0).cast("double").alias(m) for m in MEASURES])
    counters = c.agg(F.count(F.lit(1)).alias("total_api_calls"))
    report = reports.quality_report(reports.summary(counters, c, monitored, RUN.run_id, 1, 0.0, "failures"))
    failures = report.select(F.lit("failed_requests").alias("part"), F.col("failed_requests.path").alias("name"), F.lit(None).cast("bigint").alias("success"), F.col("failed_requests.count").alias("failed"))
    per_source = report.select(F.explode("api_summary").alias("name", "v")).select(F.lit("api_summary").alias("part"), "name", "v.success", "v.failed")
    missing = report.select(F.explode("missing_values").alias("name", "failed")).select(F.lit("missing_values").alias("part"), "name", F.lit(None).cast("bigint").alias("success"), "failed")
    return failures.unionByName(per_source).unionByName(missing)


@registered
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze snapshot and latest copy, written to the shared folder and read back."""
    base = _scratch(spark, "snapshot")
    rows = B.bronze(_calls(spark, sf_dir), RUN)
    snapshots.write_snapshot(rows, base, "bronze", RUN.run_id, ["source"])
    written = snapshots.read_snapshot(spark, base, "bronze", RUN.run_id)
    snapshots.write_latest(written, f"{base}/latest/raw")
    latest = spark.read.parquet(f"{base}/latest/raw")
    both = snapshots.union_sorted([written.withColumn("layer", F.lit("run")), latest.withColumn("layer", F.lit("latest"))])
    return both.groupBy("layer", "run_id", "source", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("response_time_ms").alias("ms"), F.count("error").alias("errors")
    )


@registered
def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations appended in batches by day, one batch replayed, days of several versions folded, old versions dropped; then read back."""
    stored = VersionedTable(spark, _scratch(spark, "compacted"), "data_date")
    o = obs(spark, sf_dir).select("ord", "city_id", "data_date", "value")
    for batch in (0, 1, 2, 1):
        stored.append(o.filter(F.col("ord") % 3 == batch), batch)
    stored.compact(2)
    stored.vacuum()
    rows = stored.read()
    return rows.groupBy(_day_text("data_date")).agg(F.count(F.lit(1)).alias("rows"), F.sum("ord").alias("ords"), F.countDistinct("city_id").alias("cities"))


@registered
def stream_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of a user, type and day over a stream in three runs: a tenth of the rows come a run late, a seventh come twice."""
    base = _scratch(spark, "stream_first")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value", F.col("ts").cast("date").alias("day"))
    span = events.agg(F.min("day").alias("first"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"))
    slot = F.floor(F.datediff("day", span.select("first").scalar()) * 3 / span.select("days").scalar())
    dealt = events.withColumn("slot", slot)
    late = F.when(F.col("event_id") % 10 == 0, F.least(F.col("slot") + 1, F.lit(2))).otherwise(F.col("slot"))
    dealt = dealt.withColumn("slot", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(late, F.least(late + 1, F.lit(2)))).otherwise(F.array(late)))).withColumn("slot", F.col("slot").cast("int"))
    lateness = f"{span.first().days} days"
    keys = ["user_id", "event_type", "day"]
    for k in range(3):
        dealt.filter(F.col("slot") == k).drop("slot").write.mode("append").parquet(f"{base}/landing")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/landing")
        ingest_firsts(source, keys, "event_id", "ts", lateness, f"{base}/firsts", "day", f"{base}/checkpoint").awaitTermination()
    found = read_firsts(VersionedTable(spark, f"{base}/firsts", "day"), keys, "event_id")
    return found.select("user_id", "event_type", _day_text("day"), "event_id", "value")


@registered
def metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics report of one run over all calls, as it is written and read back."""
    counters = run_summary(spark, sf_dir)
    row = reports.metrics_report(counters.select("*", F.lit(RUN.run_id).alias("run_id"), F.lit(0.0).alias("execution_time_seconds")))
    folder = f"{_scratch(spark, 'metrics_report')}/metrics"
    reports.write_report(row, folder)
    return spark.read.schema(row.schema).json(folder).select(*reports.METRICS_KEYS)


@registered
def publish_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run published in ten steps, resumed once (which writes nothing again), and every layer read back."""
    base = _scratch(spark, "publish_run")
    source = measured(spark, sf_dir).filter(F.col("status") != B.FAILED).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))
    raw, checked = B.bronze(_calls(spark, sf_dir), RUN), checked_records(source, RUN)
    publish_layers(Manifest(spark, base, RUN.run_id), raw, checked, base, RUN)
    again = Manifest(spark, base, RUN.run_id, resume=True)
    publish_layers(again, raw, checked, base, RUN)
    return read_back(spark, again, base, RUN).withColumn("written_again", F.lit(len(again.written)))


_DRIFT_COLUMNS = ["temperature", "humidity", "aqi", "pressure"]
_DRIFT_LIMITS = {"temperature": 5.0, "humidity": 10.0, "aqi": 10.0, "pressure": 10.0}


def _stored_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Value counts of both halves as stored; the earlier half in two parts, merged."""
    base = _scratch(spark, "counts")
    current, previous = _halves(spark, sf_dir)
    early = F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    for name, rows in (("now", current), ("early", previous.filter(early)), ("late", previous.filter(~early))):
        snapshots.write_snapshot(value_counts(rows, _DRIFT_COLUMNS), base, "statistics", name)
    now, first, second = (snapshots.read_snapshot(spark, base, "statistics", name).drop("run_id") for name in ("now", "early", "late"))
    return now, merged_counts(first, second)


@registered
def drift_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift from stored value counts alone, the earlier side merged from two parts."""
    return _rounded(D.drift_of_counts(*_stored_counts(spark, sf_dir), _DRIFT_LIMITS))


@registered
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift report as written and read back: one row for each of its features."""
    row = reports.drift_report(D.drift_of_counts(*_stored_counts(spark, sf_dir), _DRIFT_LIMITS), RUN.run_id, "earlier")
    folder = f"{_scratch(spark, 'drift_report')}/drift"
    reports.write_report(row, folder)
    back = spark.read.schema(row.schema).json(folder).select("run_id", "comparison", "drift_detected", F.explode("features").alias("feature", "f"))
    return _rounded(back.select("run_id", "comparison", "drift_detected", "feature", "f.*"))
