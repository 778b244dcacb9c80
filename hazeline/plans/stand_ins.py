"""Observations and landed calls derived from the driver tables, with dirt planted by expression."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.operators.standardize import Run
from hazeline.session import prepare

RUN = Run("20240131_000000_00000000", datetime(2024, 1, 31, 12, 0, tzinfo=timezone.utc))

# The same text runs in Spark and DuckDB.
OBS_COLUMNS = """
  event_id AS ord,
  user_id AS city_id,
  concat('CITY_', cast(user_id AS string)) AS city,
  cast(user_id % 25 AS int) AS nation_id,
  CASE event_id % 3 WHEN 0 THEN 'openweather' WHEN 1 THEN 'openmeteo' ELSE 'aqicn' END AS source,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
  ts,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE cast(ts AS date) END AS data_date,
  value - 20 AS temperature,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS humidity,
  CASE WHEN event_id % 17 = 0 THEN -9999.0 WHEN event_id % 13 = 0 THEN -value ELSE value END AS pm25,
  CASE WHEN event_id % 7 = 0 THEN floor(value) + 0.5 ELSE value END AS aqi,
  CASE WHEN event_id % 11 = 0 THEN ' n/a ' WHEN event_id % 23 = 0 THEN '-' ELSE concat(' ', cast(event_id % 50 AS string), ' ') END AS co_text,
  CASE WHEN event_id % 29 = 0 THEN 'oops' WHEN event_id % 31 = 0 THEN '5' ELSE props END AS raw_payload,
  cast(event_id % 1000 AS double) / 1000 AS response_time_seconds,
  value
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that parses or validates.
ROWS_OF_A_TASK = 50_000


def _spread(df: DataFrame) -> DataFrame:
    """Parsing and validation are heavy per row, so rows are dealt out evenly: files are read by row groups, which may be few and hold a million rows each.
    Counting a Parquet table reads its footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_OF_A_TASK)))


def obs(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Observations over the whole event table; ``heavy`` when each row takes much work."""
    events = table(spark, sf_dir, "events")
    events = _spread(events) if heavy else events
    return events.selectExpr(*_split(OBS_COLUMNS)).withColumn(
        "pm25", F.col("pm25").cast("double")
    ).withColumn("aqi", F.col("aqi").cast("double"))


def _split(text: str) -> list[str]:
    """One expression per line of the column list."""
    return [line.strip().rstrip(",") for line in text.strip().splitlines()]


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("record_date", F.coalesce("data_date", F.col("ts").cast("date")))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations shaped as source records: city attributes, text and number measures."""
    return obs(spark, sf_dir, heavy=True).select(
        "ord", "city", "source", "status", "data_date", F.col("ts").alias("timestamp"),
        F.when(F.col("nation_id") == 3, F.lit(" n/a ")).otherwise(F.concat(F.lit("C"), F.col("nation_id").cast("string"))).alias("country"),
        (F.col("nation_id") * 4.0).alias("latitude"), (F.col("nation_id") * 7.0).alias("longitude"),
        "temperature", "humidity", "pm25", "aqi", F.col("co_text").alias("co"), "raw_payload", "response_time_seconds",
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as calls: request errors by event type, and a normalization problem for one type."""
    o = obs(spark, sf_dir)
    return o.select(
        "ord", "source", "city", "data_date", "response_time_seconds", "raw_payload",
        F.array(F.concat(F.lit("https://example.org/"), F.col("source"))).alias("endpoint"),
        F.when(F.col("status") == "failed", F.lit("data is not an object")).alias("problem"),
        F.when(F.col("status") == "partial", F.array(F.lit("weather: HTTP 500"), F.concat(F.lit("air_quality: "), (F.col("ord") % 5).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def _payload(source: str, past: bool) -> Column:
    """JSON text of a provider payload carrying the event's value."""
    v, k = F.col("value"), F.col("event_id")
    if source == "openweather":
        rain = F.struct(F.when(k % 2 == 0, F.lit(0.0)).otherwise(v).alias("1h"), F.when(k % 5 != 0, v + 1).alias("3h"))
        item = F.struct(
            F.lit(1704103200).alias("dt"),
            F.struct((v - 20).alias("temp"), F.least(v, F.lit(100.0)).alias("humidity"), F.lit(1000).alias("pressure")).alias("main"),
            F.struct(v.alias("speed"), (k % 361).alias("deg")).alias("wind"),
            F.struct((k % 101).alias("all")).alias("clouds"),
            rain.alias("rain"),
        )
        second = F.struct(F.struct((v - 10).alias("temp")).alias("main"))
        pollution = F.struct(
            F.struct((k % 6).alias("aqi")).alias("main"),
            F.struct(v.alias("pm2_5"), (v * 2).alias("pm10"), (v * 10).alias("co"), F.when(k % 4 != 0, v).alias("no")).alias("components"),
        )
        if not past:
            whole = F.to_json(F.struct(item.alias("weather"), F.struct(F.array(pollution).alias("list")).alias("air_quality")))
            # A pollution list that is an object has no first item.
            return F.when(k % 97 == 5, F.concat(F.lit('{"weather": '), F.to_json(item), F.lit(', "air_quality": {"list": {"0": 1}}}'))).otherwise(whole)
        # Texts are joined, as the items of a list may differ in shape.
        weather = F.concat(F.lit('{"list": ['), F.to_json(item), F.lit(", "), F.to_json(second), F.lit("]}"))
        air = F.concat(F.lit('{"list": ['), F.to_json(pollution), F.lit(', {"main": {"aqi": 3}, "components": {"co": 5}}]}'))
        air = F.when(k % 9 == 0, F.lit("null")).otherwise(air)
        return F.concat(F.lit('{"weather": '), weather, F.lit(', "air_quality": '), air, F.lit("}"))
    if source == "openmeteo":
        if past:
            three = F.array(v, F.lit(None).cast("double"), v + 0.5)
            weather = F.struct(*[three.alias(f) for f in ("temperature_2m", "relative_humidity_2m", "pressure_msl", "rain")])
            air = F.struct(three.alias("pm2_5"), F.array(F.lit(None).cast("double")).alias("ammonia"), F.array((k % 6), (k % 6) + 1).alias("us_aqi"))
            return F.to_json(F.struct(F.struct(weather.alias("hourly")).alias("weather"), F.struct(air.alias("hourly")).alias("air_quality")))
        current = F.struct(
            F.when(k % 3 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("time"),
            (v - 20).alias("temperature_2m"), F.least(v, F.lit(100.0)).alias("relative_humidity_2m"), F.lit(1000).alias("pressure_msl"),
            v.alias("wind_speed_10m"), (k % 361).alias("wind_direction_10m"), (k % 101).alias("cloud_cover"), F.lit(0).alias("rain"),
        )
        air = F.struct(
            F.array(F.date_format("ts", "yyyy-MM-dd'T'00:00")).alias("time"), F.array(v, v + 1).alias("pm2_5"),
            F.array(v + 2, v).alias("pm10"), F.array((k % 6), k).alias("us_aqi"), F.array().cast("array<double>").alias("ozone"),
        )
        whole = F.to_json(F.struct(F.struct(current.alias("current")).alias("weather"), F.struct(air.alias("hourly")).alias("air_quality")))
        # Hourly values that are no list fail the call, as does text cut short; of equal keys the last counts, and an empty text is no value.
        index = F.when(k % 97 == 5, F.lit('{"x": 1}')).when(k % 97 == 6, F.lit("7")).when(k % 97 == 8, F.lit('[1], "us_aqi": [2]')).when(k % 97 == 9, F.lit('""'))
        planted = F.regexp_replace(whole, r'"us_aqi":\[[^\]]*\]', F.concat(F.lit('"us_aqi":'), index))
        return F.when(k % 97 == 7, F.substring(whole, 1, 40)).when(index.isNotNull(), planted).otherwise(whole)
    readings = F.struct(F.struct(v.alias("v")).alias("pm25"), F.when(k % 4 != 0, F.struct(v.alias("v"))).alias("no2"))
    index = F.when(k % 8 == 0, F.lit('"-"')).when(k % 8 == 1, F.lit('"12.0"')).otherwise((k % 300).cast("string"))
    data = F.concat(F.lit('{"aqi": '), index, F.lit(', "iaqi": '), F.to_json(readings), F.lit("}"))
    data = F.when(k % 10 == 0, F.lit('"Unknown station"')).otherwise(data)
    return F.when(k % 7 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"aqi": {"status": "ok", "data": '), data, F.lit("}}")))


def landed(spark: SparkSession, sf_dir: str, source: str, past: bool) -> DataFrame:
    """Every event as a landed call of one provider."""
    return _spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("ord"),
        F.lit(source).alias("source"),
        F.array(F.lit(f"https://example.org/{source}")).alias("endpoint"),
        F.concat(F.lit("CITY_"), F.col("user_id").cast("string")).alias("city"),
        (F.col("ts").cast("date") if past else F.lit(None).cast("date")).alias("data_date"),
        _payload(source, past).alias("payload"),
        F.array().cast("array<string>").alias("errors"),
        (F.col("event_id") % 1000 / 1000.0).alias("response_time_seconds"),
    )


def city_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One city per user seen in the events, with attributes derived from the id."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.lit(1).alias("_one"))
    return users.select(
        F.col("user_id").alias("position"), F.concat(F.lit("CITY_"), F.col("user_id").cast("string")).alias("city"),
        (F.col("user_id") % 90).cast("double").alias("latitude"), (F.col("user_id") % 180).cast("double").alias("longitude"),
        F.concat(F.lit("C"), (F.col("user_id") % 25).cast("string")).alias("country"),
    )
