"""URL filters by a temporal list join: dated list entries become validity intervals, and captures meet the entries active when they were fetched.

An entry names a domain (with all below it) or an address prefix (host and leading path segments). Its additions and removals, by date, are turned into intervals;
on one date a removal wins. A capture is looked up by its host's suffixes and its path's prefixes, as of its date. Time is cut into spans of
SPAN_DAYS, and both sides join on key and span: an entry with a long history, or a host with a third of all captures, meets only what lies in the same
span. Captures that agree in address and date are looked up once.

A null or unreadable address and a null date match nothing and are kept; entries without a pattern or a date have no effect; repeated entries count once;
without entries every capture stays unblocked. Rows come back one for one, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.tables import written

SPAN_DAYS = 32


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.nullif(found, F.lit(""))


def segments(url: Column) -> Column:
    """Path segments that aren't empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def keys(url: Column) -> Column:
    """All entry keys that cover the address."""
    labels, steps = F.split(host(url), r"\."), segments(url)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    upto = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(upto, lambda i: F.concat(F.lit("p:"), host(url), F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")))
    return F.concat(suffixes, prefixes)


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, key, since, until) of entries (list_name, key, listed_on, added): the spans of days in which an entry is active; until is excluded, null if it is open."""
    daily = entries.filter("key IS NOT NULL AND listed_on IS NOT NULL").groupBy("list_name", "key", F.col("listed_on").alias("since")).agg(F.min("added").alias("added"))
    along = Window.partitionBy("list_name", "key").orderBy("since")
    # One row for each date; only changes of state count.
    changes = daily.withColumn("was", F.lag("added").over(along)).filter("was IS NULL OR was <> added")
    return changes.withColumn("until", F.lead("since").over(along)).filter("added").select("list_name", "key", "since", "until")


def _span(day: Column) -> Column:
    return F.floor(F.unix_date(day) / SPAN_DAYS)


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_on) with n_active, lists and blocked."""
    captures = captures.select("page_id", "url", "fetched_on")
    days = captures.agg(F.min("fetched_on").alias("first"), F.max("fetched_on").alias("last")).first()
    active = intervals(entries)
    if days.first is None:
        spans = active.limit(0).withColumn("span", F.lit(0).cast("bigint"))
    else:
        # Days outside the captures' need no span.
        since, until = F.greatest("since", F.lit(days.first)), F.least(F.coalesce(F.date_sub("until", 1), F.lit(days.last)), F.lit(days.last))
        inside = active.filter((F.col("since") <= F.lit(days.last)) & (F.col("until").isNull() | (F.col("until") > F.lit(days.first))))
        spans = inside.withColumn("span", F.explode(F.sequence(_span(since), _span(until))))
    spans = spans.select("list_name", "key", "since", "until", "span")
    once = written(captures.select("url", "fetched_on").filter("url IS NOT NULL AND fetched_on IS NOT NULL").distinct(), "captures")
    looked = once.select("url", "fetched_on", F.explode(keys(F.col("url"))).alias("key"), _span(F.col("fetched_on")).alias("span"))
    met = looked.join(spans, ["key", "span"]).filter("since <= fetched_on AND (until IS NULL OR fetched_on < until)")
    verdicts = met.groupBy("url", "fetched_on").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"))
    verdicts = verdicts.withColumnsRenamed({"url": "met_url", "fetched_on": "met_on"})
    both = captures.join(verdicts, (captures.url == verdicts.met_url) & (captures.fetched_on == verdicts.met_on), "left")
    return both.select(*captures.columns, F.coalesce("n_active", F.lit(0)).alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), F.col("n_active").isNotNull().alias("blocked"))


def _hex(url: str, start: int, length: int) -> str:
    return f"cast(conv(substr(md5({url}), {start}, {length}), 16, 10) AS int)"


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages; the tables have no fetch dates, so each address stands for a day of one year."""
    return pages.select("page_id", "url", F.expr(f"date_add(DATE'2024-01-01', {_hex('url', 6, 3)} % 366)").alias("fetched_on"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """One dated list entry of every page: its host, the host's parent or its first directory, added or removed."""
    url = F.col("url")
    labels = F.split(host(url), r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.size(labels)), ".")).otherwise(host(url))
    kind = F.expr(_hex("url", 1, 1))
    key = F.when(kind < 4, F.concat(F.lit("d:"), host(url))).when(kind < 8, F.concat(F.lit("d:"), parent)).otherwise(F.concat(F.lit("p:"), host(url), F.lit("/"), F.get(segments(url), F.lit(0))))
    name = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), F.expr(_hex("url", 9, 1)) % 3 + 1)
    return pages.select(name.alias("list_name"), key.alias("key"), F.expr(f"date_add(DATE'2024-01-01', {_hex('url', 3, 3)} % 366)").alias("listed_on"), (F.expr(_hex("url", 2, 1)) < 8).alias("added"))


ORACLE = """
WITH parsed AS (
    SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '') AS host,
        list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps,
        DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(url), 6, 3) AS INTEGER) % 366 AS INTEGER) AS fetched_on,
        DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(url), 3, 3) AS INTEGER) % 366 AS INTEGER) AS listed_on,
        CAST('0x' || substr(md5(url), 1, 1) AS INTEGER) AS kind, CAST('0x' || substr(md5(url), 2, 1) AS INTEGER) < 8 AS added,
        ['adult', 'malware', 'spam'][CAST('0x' || substr(md5(url), 9, 1) AS INTEGER) % 3 + 1] AS list_name
    FROM pages
), labelled AS (SELECT *, string_split(host, '.') AS labels FROM parsed),
entries AS (
    SELECT list_name, listed_on, added, CASE WHEN kind < 4 OR (kind < 8 AND len(labels) <= 2) THEN 'd:' || host
        WHEN kind < 8 THEN 'd:' || array_to_string(labels[2:], '.') ELSE 'p:' || host || '/' || steps[1] END AS key FROM labelled
), daily AS (
    SELECT list_name, key, listed_on, bool_and(added) AS added FROM entries WHERE key IS NOT NULL AND listed_on IS NOT NULL GROUP BY ALL
), states AS (
    SELECT *, lead(listed_on) OVER (PARTITION BY list_name, key ORDER BY listed_on) AS until FROM daily
), looked AS (
    SELECT DISTINCT url, fetched_on, unnest(list_concat(
        list_transform(range(1, len(labels) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.')),
        list_transform(range(1, len(steps) + 1), lambda i: 'p:' || host || '/' || array_to_string(steps[:i], '/')))) AS key
    FROM labelled WHERE host IS NOT NULL
), met AS (
    SELECT l.url, l.fetched_on, count(*) AS n, string_agg(DISTINCT s.list_name, ',' ORDER BY s.list_name) AS lists
    FROM looked l JOIN states s ON l.key = s.key AND s.added AND s.listed_on <= l.fetched_on AND (s.until IS NULL OR l.fetched_on < s.until) GROUP BY ALL
)
SELECT p.page_id, p.url, CAST(p.fetched_on AS VARCHAR) AS fetched_on, coalesce(m.n, 0) AS n_active, coalesce(m.lists, '') AS lists, m.n IS NOT NULL AS blocked
FROM parsed p LEFT JOIN met m ON p.url = m.url AND p.fetched_on = m.fetched_on
"""
