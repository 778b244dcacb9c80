"""DuckDB SQL with the same result as each registered query."""

from __future__ import annotations

from hazeline.plans.stand_ins import OBS_COLUMNS

OBS = f"obs AS (SELECT {OBS_COLUMNS} FROM events)"
DATED = f"{OBS}, dated AS (SELECT *, coalesce(data_date, cast(ts AS date)) AS record_date FROM obs)"

# Calls with their outcome: a problem for one event type, request errors for another.
CALLS = f"""{OBS}, calls AS (
  SELECT *, CASE status WHEN 'failed' THEN 'data is not an object'
    WHEN 'partial' THEN concat('weather: HTTP 500; air_quality: ', cast(ord % 5 AS varchar)) END AS error
  FROM obs)"""

RUN_ID = "20240131_000000_00000000"
RETRIEVED = "2024-01-31T12:00:00.000000+00:00"
VERSIONS = "CASE source WHEN 'openweather' THEN '2.5' ELSE 'v1' END"
RUN_MS = "cast(trunc(response_time_seconds * 1000) AS int)"

# Cleaned and coerced observations with one flag per rule they can break.
CHECKED = """checked AS (
  SELECT *,
    CASE WHEN nation_id = 3 THEN NULL ELSE concat('C', nation_id) END AS country,
    nation_id * 4.0::double AS latitude, nation_id * 7.0::double AS longitude,
    CASE WHEN pm25 < 0 THEN NULL ELSE pm25 END AS pm25_c,
    cast(round_even(aqi, 0) AS bigint) AS aqi_c,
    CASE WHEN trim(co_text) IN ('', 'n/a') THEN NULL ELSE trim(co_text) END AS co_t,
    CASE WHEN raw_payload = 'oops' THEN NULL ELSE raw_payload END AS payload_c
  FROM records),
flagged AS (
  SELECT *, latitude > 90 AS bad_lat, temperature > 70 OR temperature < -80 AS bad_temp,
    coalesce(humidity > 100, false) AS bad_hum, coalesce(co_t = '-', false) AS bad_co,
    coalesce(payload_c = '5', false) AS bad_payload FROM checked)"""
VALID = "NOT (bad_lat OR bad_temp OR bad_hum OR bad_co OR bad_payload)"

EVENT_CITY = "concat('CITY_', cast(user_id AS varchar))"
CITY_ATTRIBUTES = "concat('C', cast(user_id % 25 AS varchar)) AS country, cast(user_id % 90 AS double) AS latitude"
DAY = "strftime(ts, '%Y-%m-%d')"
NUL = "cast(NULL AS double)"


def _records(where: str, timestamp: str, status: str, past: bool, **measures: str) -> str:
    names = ["temperature", "humidity", "pressure", "wind_speed", "wind_direction", "cloud_cover", "rain",
             "aqi", "pm25", "pm10", "co", "no", "no2", "so2", "o3", "nh3"]
    columns = ", ".join(f"cast({measures.get(n, 'NULL')} AS double) AS {n}" for n in names)
    day = DAY if past else "cast(NULL AS varchar)"
    return f"""SELECT event_id AS ord, {EVENT_CITY} AS city, {CITY_ATTRIBUTES}, {timestamp} AS timestamp, {status} AS status,
      {day} AS data_date, {columns} FROM (SELECT *, value AS v, event_id AS k FROM events) WHERE {where}"""


OW_RAIN = "CASE WHEN k % 2 = 1 AND v <> 0 THEN v WHEN k % 5 <> 0 THEN v + 1 WHEN k % 2 = 1 OR true THEN NULL END"
NOW = "'2024-01-31T12:00:00+00:00'"


def _statistics(column: str, source: str, name: str) -> str:
    """Nine statistics of a column whose missing values are null."""
    return f"""SELECT '{name}' AS feature, avg({column}) AS mean, median({column}) AS median, min({column}) AS minimum,
      max({column}) AS maximum, stddev_samp({column}) AS standard_deviation,
      cast(count(*) - count({column}) AS bigint) AS missing_count,
      (count(*) - count({column})) * 100.0::double / nullif(count(*), 0) AS missing_percentage,
      count(DISTINCT {column}) AS unique_values, count(*) AS record_count FROM {source}"""


LINES = """lines AS (SELECT l_quantity AS temperature, l_extendedprice AS humidity,
  CASE WHEN l_discount > 0.08 THEN NULL WHEN l_discount > 0.02 THEN l_discount END AS aqi,
  0.0::double AS pressure, l_shipdate FROM lineitem)"""
HALVES = f"""{LINES},
  now AS (SELECT * REPLACE (humidity * 1.25 AS humidity) FROM lines WHERE l_shipdate >= timestamp '1998-06-01'),
  before AS (SELECT * FROM lines WHERE l_shipdate < timestamp '1998-06-01')"""
STATS = ["mean", "median", "minimum", "maximum", "standard_deviation", "missing_count", "missing_percentage", "unique_values", "record_count"]
SHORT = {"minimum": "min", "maximum": "max", "standard_deviation": "std"}


def _side(source: str, names: list[str]) -> str:
    return " UNION ALL ".join(_statistics(n, source, n) for n in names)


def _paired(names: list[str]) -> str:
    return f"{HALVES}, c AS ({_side('now', names)}), p AS ({_side('before', names)})"


def _drift() -> str:
    names = ["temperature", "humidity", "aqi", "pressure"]
    columns = []
    for s in STATS[:-1]:
        for side, alias in (("current", "c"), ("previous", "p")):
            whole = s in ("missing_count", "unique_values")
            value = f"{alias}.{s}" if whole else f"round({alias}.{s}, 6)"
            columns.append(f"{value} AS {side}_{SHORT.get(s, s)}")
    return f"""WITH {_paired(names)} SELECT c.feature, {', '.join(columns)}, round(c.mean - p.mean, 6) AS difference,
      round(abs(c.mean - p.mean) / abs(nullif(p.mean, 0)) * 100, 6) AS percentage,
      CASE c.feature WHEN 'temperature' THEN 5.0::double ELSE 10.0::double END AS threshold
      FROM c JOIN p ON c.feature = p.feature"""


def _drift_all() -> str:
    rows = " UNION ALL ".join(
        f"SELECT c.feature, '{s}' AS statistic, cast(c.{s} AS double) AS a, cast(p.{s} AS double) AS b, c.mean AS ca, p.mean AS pa FROM c JOIN p ON c.feature = p.feature"
        for s in STATS
    )
    limit = "CASE feature WHEN 'temperature' THEN 5.0::double ELSE 10.0::double END"
    return f"""WITH {_paired(['temperature', 'humidity', 'pressure'])}, r AS ({rows})
      SELECT feature, statistic, round(a, 6) AS current, round(b, 6) AS previous, round(a - b, 6) AS difference,
        round(abs(a - b) / abs(nullif(b, 0)) * 100, 6) AS percentage, {limit} AS threshold,
        coalesce(abs(ca - pa) / abs(nullif(pa, 0)) * 100 >= {limit}, false) AS drift_detected FROM r"""


GRID = "103079215104.0::double"
# Nearest double to the exact mean, then rounding by its binary value; see the number functions.
DAILY_MEAN = f"""WITH s AS (
    SELECT user_id, cast(ts AS date) AS day, sum((value + {GRID}) - {GRID}) AS c, sum(value - ((value + {GRID}) - {GRID})) AS f,
      cast(count(*) AS double) AS n FROM events GROUP BY ALL),
  q AS (SELECT *, c + f AS t, f - ((c + f) - c) AS l, (c + f) / n AS q FROM s),
  h AS (SELECT *, (q * 134217729.0::double) - ((q * 134217729.0::double) - q) AS qh FROM q),
  m AS (SELECT user_id, day, q + (((t - qh * n) - (q - qh) * n) + l) / n AS m FROM h),
  r AS (SELECT *, floor(m * 10000.0::double) AS k, (m * 134217729.0::double) - ((m * 134217729.0::double) - m) AS mh FROM m),
  e AS (SELECT *, (mh * 20000.0::double - (k * 2 + 1)) + (m - mh) * 20000.0::double AS past FROM r)
  SELECT user_id, day, (k + CASE WHEN past > 0 THEN 1 WHEN past = 0 THEN k % 2 ELSE 0 END) / 10000.0::double AS mean FROM e"""

ORACLES: dict[str, str] = {
    "fuse_daily": f"""WITH {DATED}, r AS (
        SELECT *, row_number() OVER (PARTITION BY city, record_date ORDER BY ord) AS rn FROM dated)
      SELECT city, record_date, ord, 'merged' AS source, source AS first_source, temperature, humidity,
        cast(pm25 AS double) AS pm25, cast(aqi AS double) AS aqi, co_text, response_time_seconds FROM r WHERE rn = 1""",
    "dedup_first": f"""WITH {OBS}, r AS (
        SELECT *, strftime(ts, '%Y-%m-%d') AS timestamp,
          row_number() OVER (PARTITION BY city, data_date, strftime(ts, '%Y-%m-%d'), source ORDER BY ord) AS rn FROM obs)
      SELECT ord, city, data_date, timestamp, source, value FROM r WHERE rn = 1""",
    "dedup_lineitem": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate,
          l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
      FROM r WHERE rn = 1""",
    "gold_lineage": f"""WITH {DATED}
      SELECT city, strftime(record_date, '%Y-%m-%d') AS data_date, 'merged' AS source, 'merged' AS status, 'merged' AS endpoint,
        arg_min(temperature, ord) AS temperature, cast(count(*) AS int) AS records,
        string_agg(source, ',' ORDER BY ord) AS sources, string_agg(source, ',' ORDER BY ord) AS endpoints,
        string_agg(coalesce(strftime(data_date, '%Y%m%d'), '-'), ',' ORDER BY ord) AS days,
        'merged' AS source_api, strftime(record_date, '%Y-%m-%d') AS lineage_date
      FROM dated GROUP BY city, record_date""",
    "lineage_records": f"""WITH {DATED}
      SELECT 'merged' AS source_api, city, strftime(record_date, '%Y-%m-%d') AS data_date, ord, source, source AS endpoint, temperature, status,
        response_time_seconds FROM dated""",
    "lineage_slices": f"""WITH {OBS}, sized AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM obs),
        cut AS (SELECT *, CASE WHEN n > 500 THEN ord // 500 ELSE 0 END AS slice FROM sized)
      SELECT source, cast(slice AS bigint) AS slice, cast(count(*) AS int) AS n, arg_min(city, ord) AS first_city,
        arg_max(city, ord) AS last_city, string_agg(city, ',' ORDER BY ord) AS cities FROM cut GROUP BY source, slice""",
    "upsert_latest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
          ORDER BY o_orderdate DESC, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END DESC, o_orderkey DESC) AS rn FROM orders)
      SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice
      FROM r WHERE rn = 1""",
    "upsert_key": """SELECT c_custkey AS key, c_acctbal AS amount, 'customer' AS origin, cast(NULL AS bigint) AS o_orderkey
      FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
      UNION ALL SELECT o_custkey, arg_max(o_totalprice, o_orderkey), 'orders', max(o_orderkey) FROM orders GROUP BY o_custkey""",
    "record_key": f"""SELECT o_orderkey, sha1(concat('{{"cents":', cast(round(o_totalprice * 100) AS bigint),
        ',"o_orderdate":"', strftime(o_orderdate, '%Y-%m-%d'), '","o_orderkey":', o_orderkey, ',"o_orderpriority":"', o_orderpriority,
        '","o_orderstatus":', CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE concat('"', o_orderstatus, '"') END,
        ',"run_id":"{RUN_ID}"}}')) AS record_key FROM orders""",
    "dim_join": f"""WITH {OBS}
      SELECT ord, n_name AS city, r_name AS country, n_nationkey * 3.0::double AS latitude, n_nationkey * 7.0::double AS longitude,
        CASE WHEN n_nationkey % 5 <> 0 THEN concat('K', n_nationkey) END AS location_id,
        CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 0 THEN concat('N', n_nationkey) END AS exact_id
      FROM obs JOIN nation ON nation_id = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "map_explode": """WITH pairs AS (
        SELECT p_partkey, 0 AS position, p_name AS name, p_brand AS location_id FROM part WHERE p_partkey % 10 <> 9),
      keyed AS (SELECT *, 0 AS form, name AS key FROM pairs UNION ALL
        SELECT *, 1, regexp_replace(regexp_replace(upper(name), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FROM pairs)
      SELECT key, arg_max(location_id, p_partkey * 10 + position * 2 + form) AS location_id FROM keyed GROUP BY key""",
    "city_key": """SELECT regexp_replace(regexp_replace(upper(raw), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS setting_key,
        regexp_replace(regexp_replace(upper(raw), '[^\\p{L}\\p{N}]', '_', 'g'), '^_+|_+$', '', 'g') AS city_key, count(*) AS n
      FROM (SELECT concat('(é ', p_name, ' -- ', p_brand, ')') AS raw FROM part) GROUP BY 1, 2""",
    "live_spine": f"""SELECT DISTINCT cast(user_id * 3 + i AS bigint) AS ord, {EVENT_CITY} AS city, source, cast(NULL AS date) AS data_date
      FROM events, (VALUES (0, 'openweather'), (1, 'openmeteo'), (2, 'aqicn')) s(i, source)""",
    "date_spine": """WITH days AS (SELECT cast(unnest(generate_series(min(cast(ts AS date)), max(cast(ts AS date)), interval 1 day)) AS date) AS d FROM events)
      SELECT cast(((d - date '1970-01-01') * 25 + n_nationkey) * 2 + i AS bigint) AS ord, n_name AS city, source, d AS data_date
      FROM nation, days, (VALUES (0, 'openweather'), (1, 'openmeteo')) s(i, source)""",
    "landing_gaps": f"""WITH {OBS},
      days AS (SELECT cast(unnest(generate_series(min(cast(ts AS date)), max(cast(ts AS date)), interval 1 day)) AS date) AS d FROM events),
      spine AS (SELECT city, source, d AS data_date FROM (SELECT DISTINCT city FROM obs), days, (VALUES ('openweather'), ('openmeteo')) s(source))
      SELECT * FROM spine WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.city = spine.city AND obs.source = spine.source AND cast(obs.ts AS date) = spine.data_date)""",
    "planned_requests": """WITH days AS (SELECT cast(unnest(generate_series(min(cast(ts AS date)), max(cast(ts AS date)), interval 1 day)) AS date) AS d FROM events),
      spine AS (
        SELECT n_nationkey * 3 + i AS ord, n_nationkey AS k, n_name AS city, source, cast(NULL AS date) AS d
        FROM nation, (VALUES (0, 'openweather'), (1, 'openmeteo'), (2, 'aqicn')) s(i, source)
        UNION ALL SELECT ((d - date '1970-01-01') * 25 + n_nationkey) * 2 + i, n_nationkey, n_name, source, d
        FROM nation, days, (VALUES (0, 'openweather'), (1, 'openmeteo')) s(i, source)),
      w AS (SELECT *, epoch(d)::bigint AS e, concat(epoch(d)::bigint, '/', epoch(d)::bigint + 86399) AS span,
        source = 'openweather' AND d IS NOT NULL AND k % 2 = 0 AS weather FROM spine)
      SELECT cast(ord AS bigint) AS ord, city, source, d AS data_date,
        CASE WHEN source = 'aqicn' THEN 'aqi' WHEN source = 'openweather' AND d IS NOT NULL AND NOT weather THEN 'air_quality' ELSE 'weather,air_quality' END AS labels,
        CASE WHEN source = 'aqicn' THEN concat('https://api.waqi.info/feed/', city, '/')
          WHEN source = 'openmeteo' AND d IS NULL THEN 'https://api.open-meteo.com/v1/forecast,https://air-quality-api.open-meteo.com/v1/air-quality'
          WHEN source = 'openmeteo' THEN 'https://archive-api.open-meteo.com/v1/archive,https://air-quality-api.open-meteo.com/v1/air-quality'
          WHEN d IS NULL THEN 'https://api.openweathermap.org/data/2.5/weather,https://api.openweathermap.org/data/2.5/air_pollution'
          ELSE concat(CASE WHEN weather THEN 'https://history.openweathermap.org/data/3.0/history/result,' ELSE '' END, 'https://api.openweathermap.org/data/2.5/air_pollution/history') END AS urls,
        CASE WHEN source = 'aqicn' THEN '' WHEN d IS NULL THEN ',' WHEN source = 'openmeteo' THEN concat(d, ',', d)
          ELSE concat(CASE WHEN weather THEN concat(span, '/L', k, ',') ELSE '' END, span) END AS "window" FROM w""",
    "epoch_window": """SELECT DISTINCT cast(o_orderdate AS date) AS day, epoch(cast(o_orderdate AS date))::bigint AS start,
        epoch(cast(o_orderdate AS date))::bigint + 86399 AS "end" FROM orders""",
    "json_extract": """SELECT event_id, cast(json_extract(props, '$.k') AS double) AS k,
        CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props, '$.k') END AS kind,
        json_extract(props, '$.missing') IS NULL AS missing FROM events""",
    "payload_json": f"""WITH {OBS}, t AS (SELECT ord, trim(CASE WHEN ord % 37 = 0 THEN ' N/a ' WHEN ord % 41 = 0 THEN ' [1, 2] '
          WHEN ord % 43 = 0 THEN 'null' WHEN ord % 47 = 0 THEN '{{"a": 1, "a": [2]}}' WHEN ord % 53 = 0 THEN '{{"a": NaN, "b": [-Infinity]}}' ELSE raw_payload END) AS raw FROM obs),
        d AS (SELECT ord, CASE WHEN upper(raw) NOT IN ('', 'N/A') AND (contains(raw, 'NaN') OR json_valid(raw)) AND raw <> 'null' THEN raw END AS document FROM t)
      SELECT ord, document, document IS NOT NULL AND left(document, 1) NOT IN ('{{', '[') AS rejected FROM d""",
    "openweather_live": _records(
        "k % 97 <> 5", NOW, "'success'", False, temperature="v - 20", humidity="least(v, 100.0)", pressure="1000", wind_speed="v",
        wind_direction="k % 361", cloud_cover="k % 101", rain=OW_RAIN, aqi="k % 6", pm25="v", pm10="v * 2", co="v * 10",
        no="CASE WHEN k % 4 <> 0 THEN v END"),
    "openweather_history": _records(
        "k % 9 <> 0", "'2024-01-01T10:00:00+00:00'", "'success'", True, temperature="round(((v - 20) + (v - 10)) / 2, 4)",
        humidity="least(v, 100.0)", pressure="1000", wind_speed="v", wind_direction="k % 361", cloud_cover="k % 101", rain=f"round({OW_RAIN}, 4)",
        aqi="(k % 6 + 3) / 2", pm25="v", pm10="round(v * 2, 4)", co="round((v * 10 + 5) / 2, 4)", no="CASE WHEN k % 4 <> 0 THEN v END"),
    "openmeteo_live": _records(
        "k % 97 NOT IN (5, 6, 7)", "CASE WHEN k % 3 = 0 THEN strftime(ts, '%Y-%m-%dT00:00') ELSE strftime(ts, '%Y-%m-%dT%H:%M') END", "'success'", False,
        temperature="v - 20", humidity="least(v, 100.0)", pressure="1000", wind_speed="v", wind_direction="k % 361",
        cloud_cover="k % 101", rain="0", aqi="CASE WHEN k % 97 = 8 THEN 2 WHEN k % 97 <> 9 THEN k % 6 END", pm25="v", pm10="v + 2"),
    "openmeteo_history": _records(
        "true", DAY, "'success'", True, temperature="round((v + (v + 0.5)) / 2, 4)", humidity="round((v + (v + 0.5)) / 2, 4)",
        pressure="round((v + (v + 0.5)) / 2, 4)", rain="round((v + (v + 0.5)) / 2, 4)", pm25="round((v + (v + 0.5)) / 2, 4)",
        aqi="round_even(k % 6 + 0.5, 0)"),
    "aqicn_live": _records(
        "k % 7 = 0 OR k % 10 <> 0", NOW, "CASE WHEN k % 7 = 0 THEN 'failed' ELSE 'success' END", False,
        aqi="CASE WHEN k % 7 = 0 OR k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 12 ELSE k % 300 END",
        pm25="CASE WHEN k % 7 <> 0 THEN v END", no2="CASE WHEN k % 7 <> 0 AND k % 4 <> 0 THEN v END"),
    "landed_to_gold": f"""WITH ow AS (SELECT event_id * 2 AS ord, {EVENT_CITY} AS city, cast(ts AS date) AS d, event_id AS k, 'openweather' AS source,
          timestamp '2024-01-01 10:00:00' AS stamp, round(((value - 20) + (value - 10)) / 2, 4) AS temperature, least(value, 100.0) AS humidity,
          cast(round_even((event_id % 6 + 3) / 2, 0) AS bigint) AS aqi, value AS pm25,
          CASE WHEN event_id % 4 <> 0 THEN value END AS no, '2.5' AS version FROM events WHERE event_id % 9 <> 0),
        om AS (SELECT event_id * 2 + 1 AS ord, {EVENT_CITY} AS city, cast(ts AS date) AS d, event_id AS k, 'openmeteo' AS source,
          cast(cast(ts AS date) AS timestamp) AS stamp, round((value + (value + 0.5)) / 2, 4) AS temperature, round((value + (value + 0.5)) / 2, 4) AS humidity,
          cast(round_even(event_id % 6 + 0.5, 0) AS bigint) AS aqi, round((value + (value + 0.5)) / 2, 4) AS pm25, NULL AS no, 'v1' AS version FROM events),
        source_rows AS (SELECT * FROM ow UNION ALL SELECT * FROM om),
        kept AS (SELECT *, row_number() OVER (PARTITION BY city, d, stamp, source ORDER BY ord) AS rn FROM source_rows),
        silver AS (SELECT * FROM kept WHERE rn = 1 AND temperature BETWEEN -80 AND 70 AND humidity <= 100),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY city, d ORDER BY ord) AS place,
          string_agg(source, ',') OVER (PARTITION BY city, d ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sources FROM silver)
      SELECT city, strftime(d, '%Y-%m-%d') AS data_date, 'merged' AS source, temperature, humidity, aqi, pm25, cast(no AS double) AS no,
        version AS api_version, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS timestamp, sources FROM ranked WHERE place = 1""",
    "array_first": f"""SELECT vec_id, cast(round(embedding[1]::double * 1000000) AS bigint) AS first, {NUL} AS empty FROM embeddings""",
    "array_mean": f"""WITH x AS (SELECT vec_id, unnest(embedding)::double AS x FROM embeddings),
        s AS (SELECT vec_id, sum(CASE WHEN x >= 0 THEN cast(round(x * 1000) AS bigint) END)::bigint AS s, count(CASE WHEN x >= 0 THEN 1 END) AS n FROM x GROUP BY vec_id)
      SELECT vec_id, CASE WHEN n > 0 THEN round_even(s::double / n * 10000, 0) / 10000 END AS mean, {NUL} AS empty FROM s""",
    "daily_mean": DAILY_MEAN,
    "call_status": f"WITH {CALLS} SELECT ord, status, error FROM calls",
    "bronze": f"""WITH {CALLS} SELECT '{RUN_ID}' AS run_id, source, concat('https://example.org/', source) AS endpoint, city, status,
        '2.2.0' AS pipeline_version, {VERSIONS} AS api_version, '{RETRIEVED}' AS retrieved_at, {RUN_MS} AS response_time_ms,
        response_time_seconds, error, strftime(data_date, '%Y-%m-%d') AS data_date, raw_payload FROM calls""",
    "failed_requests": f"""WITH {CALLS} SELECT source, city, CASE WHEN ord % 3 <> 0 THEN error ELSE 'Unknown error' END AS error
      FROM calls WHERE status <> 'success'""",
    "call_log": f"""WITH {CALLS} SELECT ord, concat('City=', city, ' | API=', source, ' | Status=', upper(status), ' | ResponseTime=',
        cast(trunc(response_time_seconds * 1000) AS bigint), 'ms', CASE WHEN error IS NOT NULL THEN concat(' | Reason=', error) ELSE '' END) AS line FROM calls""",
    "api_summary": f"""WITH {CALLS} SELECT source, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status <> 'success') AS failed
      FROM calls GROUP BY source""",
    "null_tokens": f"""WITH {OBS} SELECT ord, CASE WHEN upper(trim(co_text)) IN ('', 'N/A') THEN NULL ELSE trim(co_text) END AS co_text, source FROM obs""",
    "sentinels": f"""WITH {OBS} SELECT ord, cast(CASE WHEN pm25 < 0 THEN NULL ELSE pm25 END AS double) AS pm25, cast(pm25 AS double) AS temperature,
        cast(pm25 AS double) AS co, cast(CASE WHEN ord % 5 = 0 OR ord % 9 < 4 THEN NULL ELSE ord % 9 - 4 END AS int) AS no2 FROM obs""",
    "aqi_round": f"WITH {OBS} SELECT ord, cast(round_even(aqi - 1, 0) AS bigint) AS aqi FROM obs",
    "falsy_or": f"""WITH {OBS} SELECT ord, coalesce(nullif(CASE ord % 3 WHEN 0 THEN 0.0::double WHEN 1 THEN humidity END, 0),
        CASE WHEN ord % 4 <> 0 THEN value + 1 END) AS rain FROM obs""",
    "validated": f"""WITH {DATED}, records AS (SELECT * FROM dated), {CHECKED}
      SELECT ord, city, country, latitude, temperature, humidity, cast(pm25_c AS double) AS pm25, aqi_c AS aqi, cast(co_t AS double) AS co,
        payload_c AS raw_payload, record_date FROM flagged WHERE {VALID}""",
    "quarantine": f"""WITH {DATED}, records AS (SELECT * FROM dated), {CHECKED},
      rules AS (SELECT 'latitude:range' AS rule FROM flagged WHERE bad_lat UNION ALL SELECT 'temperature:range' FROM flagged WHERE bad_temp
        UNION ALL SELECT 'humidity:range' FROM flagged WHERE bad_hum UNION ALL SELECT 'co:type' FROM flagged WHERE bad_co
        UNION ALL SELECT 'raw_payload:type' FROM flagged WHERE bad_payload)
      SELECT rule, count(*) AS rows FROM rules GROUP BY rule""",
    "standardized": f"""WITH {OBS} SELECT ord, '{RUN_ID}' AS run_id, '2.2.0' AS pipeline_version,
        CASE WHEN source = 'openweather' AND ord % 4 = 0 THEN '3.0' ELSE {VERSIONS} END AS api_version,
        CASE WHEN ord % 9 <> 0 THEN {RUN_MS} ELSE 0 END AS response_time_ms, '{RETRIEVED}' AS retrieved_at FROM obs""",
    "lineage": f"""WITH {OBS} SELECT ord, source AS source_api, concat(source, ',', city) AS endpoint, city, '{RUN_ID}' AS run_id,
        '{RETRIEVED}' AS retrieved_at, {RUN_MS} AS response_time_ms, response_time_seconds, '2.2.0' AS pipeline_version, {VERSIONS} AS api_version FROM obs""",
    "raw_table": f"""WITH {CALLS}, c AS (SELECT '{RUN_ID}' AS run_id, * FROM calls UNION ALL SELECT '20240201_000000_00000001', * FROM calls WHERE source = 'aqicn')
      SELECT run_id, source, status, count(*) AS rows, count(*) AS keys FROM (SELECT DISTINCT run_id, source, city, status, error, data_date, raw_payload,
        response_time_seconds FROM c) GROUP BY ALL""",
    "feature_table": """WITH o AS (SELECT o_custkey AS city, CASE WHEN o_custkey % 7 <> 0 THEN concat('2024-01-', lpad(cast(o_custkey % 20 + 1 AS varchar), 2, '0')) END AS data_date,
        o_orderkey AS retrieved_at, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' OR o_custkey % 3 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY retrieved_at DESC) AS rn FROM o)
      SELECT city, data_date, retrieved_at, status FROM r WHERE rn = 1""",
    "run_reports": f"""WITH {CALLS}, {DATED[len(OBS) + 2:]}, g AS (SELECT *, row_number() OVER (PARTITION BY city, record_date ORDER BY ord) AS rn FROM dated),
        m AS (SELECT count(*) FILTER (humidity IS NULL) AS h, count(*) AS r FROM g WHERE rn = 1)
      SELECT 'failed_requests' AS part, 'failures' AS name, cast(NULL AS bigint) AS success, count(*) FILTER (status <> 'success') AS failed FROM calls
      UNION ALL SELECT 'api_summary', CASE WHEN ord % 10 = 0 THEN 'unknown' ELSE source END, count(*) FILTER (status = 'success'), count(*) FILTER (status <> 'success') FROM calls GROUP BY 2
      UNION ALL SELECT * FROM (SELECT 'missing_values', 'humidity', cast(NULL AS bigint), h FROM m UNION ALL SELECT 'missing_values', 'rain', NULL, r FROM m) x(a, b, c, d) WHERE d > 0""",
    "missing_values": f"""WITH {DATED}, g AS (SELECT *, row_number() OVER (PARTITION BY city, record_date ORDER BY ord) AS rn FROM dated),
        m AS (SELECT count(*) FILTER (humidity IS NULL) AS h, count(*) FILTER (pm25 = -9999) AS p, count(*) AS r FROM g WHERE rn = 1)
      SELECT * FROM (SELECT 'humidity' AS field, h AS missing FROM m UNION ALL SELECT 'pm25', p FROM m UNION ALL SELECT 'rain', r FROM m) WHERE missing > 0""",
    "run_summary": f"""WITH {DATED}, ok AS (SELECT * FROM dated WHERE status <> 'failed'),
        records AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city, data_date, cast(ts AS date), source ORDER BY ord) AS rn FROM ok) WHERE rn = 1),
        {CHECKED}, t AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS good, count(*) FILTER (status <> 'failed') AS src FROM obs),
        c AS (SELECT count(*) AS dedup, count(*) FILTER ({VALID}) AS valid FROM flagged),
        g AS (SELECT count(*) AS gold FROM (SELECT DISTINCT city, record_date FROM flagged WHERE {VALID}))
      SELECT total AS total_api_calls, good AS successful_calls, total - good AS failed_calls, valid AS rows_processed,
        src - valid AS rows_skipped, dedup - valid AS invalid_records, src - dedup AS duplicates_removed, valid AS silver_rows, gold AS gold_rows FROM t, c, g""",
    "column_stats": f"""WITH {LINES}, s AS ({_side('lines', ['temperature', 'humidity', 'aqi', 'pressure'])})
      SELECT feature, {', '.join(s if s in ('missing_count', 'unique_values', 'record_count') else f'round({s}, 6) AS {s}' for s in STATS)} FROM s""",
    "drift": _drift(),
    "drift_flag": f"""WITH {_paired(['temperature', 'humidity', 'aqi'])}
      SELECT bool_or(coalesce(abs(c.mean - p.mean) / abs(nullif(p.mean, 0)) * 100 >= CASE c.feature WHEN 'temperature' THEN 5 ELSE 10 END, false)) AS drift_detected,
        count(*) AS features FROM c JOIN p ON c.feature = p.feature""",
    "drift_stored": f"""WITH {_paired(['temperature', 'humidity', 'aqi', 'pressure'])}
      SELECT 'stored' AS against, bool_or(coalesce(abs(c.mean - p.mean) / abs(nullif(p.mean, 0)) * 100 >= CASE c.feature WHEN 'temperature' THEN 5 ELSE 10 END, false)) AS drift_detected,
        count(*) AS features FROM c JOIN p ON c.feature = p.feature UNION ALL SELECT 'absent', false, 0""",
    "unreadable_calls": """WITH e AS (SELECT event_id AS k, event_id % 11 = 0 AS cut, event_id % 10 = 0 AND event_id % 7 <> 0 AS unknown_station FROM events)
      SELECT CASE WHEN cut THEN 'unknown' ELSE 'aqicn' END AS source, CASE WHEN cut OR unknown_station THEN 'failed' ELSE 'success' END AS status, cut AS no_city,
        cut OR k % 7 = 0 AS no_payload, CASE WHEN cut THEN 'unreadable call' WHEN unknown_station THEN 'data is not an object' ELSE '' END AS error, count(*) AS rows FROM e GROUP BY ALL""",
    "location_overrides": """WITH pairs AS (SELECT 0 AS stage, p_partkey AS row, p_name AS name, p_brand AS location_id FROM part
        UNION ALL SELECT 1, 0, p_name, min(p_type) FROM part WHERE length(p_name) % 2 = 0 GROUP BY p_name),
      keyed AS (SELECT *, 0 AS form, name AS key FROM pairs UNION ALL
        SELECT *, 1, regexp_replace(regexp_replace(upper(name), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FROM pairs),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY stage DESC, row DESC, form DESC) AS rn FROM keyed)
      SELECT key, location_id FROM r WHERE rn = 1""",
    "required_fields": """SELECT rule, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN event_id % 30 = 0 THEN 'city:required' END, CASE WHEN event_id % 40 = 0 THEN 'source:required' END,
        CASE WHEN event_id % 50 = 0 THEN 'timestamp:required' END, CASE WHEN event_id % 70 = 0 THEN 'latitude:required' END], lambda x: x IS NOT NULL)) AS rule FROM events) GROUP BY rule""",
    "drift_all_stats": _drift_all(),
    "drift_no_baseline": "SELECT false AS drift_detected, cast(count(*) AS bigint) AS features FROM lineitem WHERE l_quantity < 0",
    "feature_projection": f"""WITH {OBS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, data_date, city, temperature, humidity,
        cast(aqi AS double) AS aqi, cast(pm25 AS double) AS pm25, source, status, response_time_seconds FROM obs""",
    "coerce_features": f"""WITH {OBS} SELECT city, try_cast(trim(co_text) AS double) AS co, humidity,
        CASE WHEN ord % 6 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp, strftime(data_date, '%Y-%m-%d 00:00:00') AS data_date,
        cast(ord AS varchar) AS run_id, source AS endpoint FROM obs""",
    "union_sorted_cols": """SELECT c_acctbal, c_custkey, c_mktsegment, c_name AS name, c_nationkey AS nationkey, cast(NULL AS double) AS s_acctbal, cast(NULL AS bigint) AS s_suppkey FROM customer
      UNION ALL SELECT NULL, NULL, NULL, s_name, s_nationkey, s_acctbal, s_suppkey FROM supplier""",
    "snapshot": f"""WITH {CALLS}, g AS (SELECT source, status, count(*) AS rows, sum({RUN_MS})::bigint AS ms, count(error) AS errors FROM calls GROUP BY source, status)
      SELECT layer, '{RUN_ID}' AS run_id, source, status, rows, ms, errors FROM g, (VALUES ('run'), ('latest')) l(layer)""",
    "compacted_table": f"""WITH {OBS} SELECT strftime(data_date, '%Y-%m-%d') AS data_date, count(*) AS rows, sum(ord)::bigint AS ords, count(DISTINCT city_id) AS cities FROM obs GROUP BY data_date""",
    "stream_first": """SELECT user_id, event_type, strftime(cast(ts AS date), '%Y-%m-%d') AS day, min(event_id) AS event_id, arg_min(value, event_id) AS value
      FROM events GROUP BY user_id, event_type, cast(ts AS date)""",
}
ORACLES["metrics_report"] = f"""SELECT '{RUN_ID}' AS run_id, total_api_calls, successful_calls, failed_calls, rows_processed, rows_skipped, invalid_records, duplicates_removed,
  cast(0 AS double) AS execution_time_seconds FROM ({ORACLES['run_summary']})"""
ORACLES["publish_run"] = f"""WITH c AS ({ORACLES['run_summary']}), layers(layer, n) AS (
  SELECT unnest(['bronze', 'checked', 'silver', 'quarantine', 'gold', 'lineage', 'raw_records', 'daily_features']),
    unnest([total_api_calls, rows_processed + invalid_records, rows_processed, invalid_records, gold_rows, rows_processed, total_api_calls, gold_rows]) FROM c)
  SELECT layer, cast(n AS bigint) AS "rows", cast(n AS bigint) AS stored_rows, true AS complete, 0 AS written_again FROM layers"""
ORACLES["drift_merged"] = ORACLES["drift"]
ORACLES["drift_report"] = f"""SELECT '{RUN_ID}' AS run_id, 'earlier' AS comparison, bool_or(coalesce(percentage >= threshold, false)) OVER () AS drift_detected, d.* FROM ({ORACLES['drift']}) d"""
