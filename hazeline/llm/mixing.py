"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source expects target / source size copies. The documents of a source stand in a fixed order (size class, hash bucket, size,
hash of the id), so the prefix sum of expected copies before a document is its position times that figure; with one random offset a
document is taken once per integer the sum crosses. Sums are integers in units of 2**-32 copies: reruns agree, and no document
is taken more than three times. As sizes ascend along the order, the words taken come near the target.

Positions come from counts per cell (source, size class, one of 256 hash buckets) and the place within a cell, so that a source with a third of
all rows is spread over its cells.

A null text has size 0; a null source is a source, the last one. A source without words has target 0. Repeated ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.tables import n_words, ranked, rest_of, written

UNIT = 1 << 32
_WIDE = "decimal(38,0)"


def _size_class(size: Column) -> Column:
    """Sixteen classes for each power of two."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.floor(size * 16 / F.pow(F.lit(2.0), bits - 1)).cast("int") - 16


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, step) of sizes (source, source_size). step: expected copies of a document, in UNITs.

    Weights repeat along the sources by code point, null last. All words are shared by weight; a target stops at most times its
    source's size, and the excess is shared by weight among the others until none is above.
    """
    choice = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    known = ranked(sizes, [F.col("source").asc_nulls_last()], "place").withColumn("weight", choice.cast("bigint")).drop("place")
    known = written(known, "sources")
    size, weight = F.col("source_size").cast("decimal(20,0)"), F.col("weight").cast("decimal(20,0)")
    total, spread = (int(x or 0) for x in known.agg(F.sum("source_size").cast(_WIDE), F.sum("weight").cast(_WIDE)).first())
    # Words for each unit of weight, a fraction. It only rises, and so does the set of sources that stop.
    words, units = total, spread or 1

    def stops(words: int, units: int) -> Column:
        return (size * F.lit(most) * F.lit(units).cast("decimal(20,0)")).cast(_WIDE) < (F.lit(words).cast("decimal(20,0)") * weight).cast(_WIDE)

    while True:
        over = stops(words, units)
        held, rest = known.agg(F.sum(F.when(over, F.col("source_size") * most)).cast(_WIDE), F.sum(F.when(~over, F.col("weight"))).cast(_WIDE)).first()
        now = (total - int(held or 0), int(rest or 0))
        if not now[1] or now[0] * units == words * now[1]:
            break
        words, units = now
    share = (F.lit(words).cast("decimal(20,0)") * weight).cast(_WIDE)
    full = stops(words, units) | (F.col("source_size") == 0)
    step = F.when(F.col("source_size") == 0, 0).when(full, most * UNIT).otherwise(
        F.expr(f"CAST({words} AS DECIMAL(20,0)) * weight * {UNIT} div (CAST({units} AS DECIMAL(20,0)) * source_size)")
    )
    target = F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share.cast("double") / F.lit(float(units)))
    return known.select("source", "source_size", target.alias("target"), step.cast("bigint").alias("step"))


def offset(seed: str, source: Column) -> Column:
    """The random offset of a source, below UNIT."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, copies, taken) of each row of docs (doc_id, text, source)."""
    size = n_words(F.col("text"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"), key.alias("hash"))
    rows = written(rows.withColumn("class", _size_class(F.col("size"))).withColumn("bucket", F.substring("hash", 1, 2)), "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    cells = rows.groupBy("source", "class", "bucket").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    cells = cells.select(F.col("source").alias("cell_source"), F.col("class").alias("cell_class"), F.col("bucket").alias("cell_bucket"), "before")
    place = F.row_number().over(Window.partitionBy("source", "class", "bucket").orderBy("size", "hash", "doc_id", "text_hash"))
    placed = rows.withColumn("place", place - 1)
    placed = placed.join(cells, placed.source.eqNullSafe(cells.cell_source) & (placed["class"] == cells.cell_class) & (placed.bucket == cells.cell_bucket))
    goals = goals.withColumnRenamed("source", "goal_source")
    placed = placed.join(goals, placed.source.eqNullSafe(goals.goal_source)).withColumn("at", (F.col("before") + F.col("place")).cast("decimal(20,0)"))
    passed = (F.col("at") * F.col("step").cast("decimal(12,0)") + offset(seed, F.col("source"))) % F.lit(UNIT)
    copies = F.shiftright(passed.cast("bigint") + F.col("step"), 32)
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that agree in id, text and source give their copies together."""
    counts = mixed(docs, weights, most, seed).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("__key_copies")).filter("__key_copies > 0")
    counts = counts.select(F.col("doc_id").alias("__key_id"), F.col("text_hash").alias("__key_hash"), F.col("source").alias("__key_source"), "__key_copies")
    hashed = docs.withColumn("__key_text", F.xxhash64("text"))
    chosen = hashed.join(counts, hashed.doc_id.eqNullSafe(counts["__key_id"]) & (hashed["__key_text"] == counts["__key_hash"]) & hashed.source.eqNullSafe(counts["__key_source"]))
    first = F.row_number().over(Window.partitionBy("__key_id", "__key_hash", "__key_source").orderBy(rest_of(docs)))
    chosen = chosen.withColumn("__key_rank", first).filter("__key_rank = 1")
    return chosen.withColumn("__key_copy", F.explode(F.sequence(F.lit(1), F.col("__key_copies").cast("int")))).select(*docs.columns)


ORACLE = """
WITH rows AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM rows GROUP BY source
), tries AS (
    SELECT a.s AS own_s, a.w AS own_w,
        (SELECT sum(s) FROM sources) - coalesce(sum(3 * b.s) FILTER (b.s * a.w < a.s * b.w), 0) AS words,
        sum(b.w) FILTER (b.s * a.w >= a.s * b.w) AS units
    FROM sources a CROSS JOIN sources b GROUP BY a.source, a.s, a.w
), chosen AS (
    SELECT CAST(words AS HUGEINT) AS words, CAST(units AS HUGEINT) AS units FROM tries
    WHERE words * own_w <= 3 * own_s * units ORDER BY CAST(own_s AS DOUBLE) / own_w LIMIT 1
), goals AS (
    SELECT source, s, CASE WHEN s = 0 OR 3 * s * units < words * w THEN CAST(3 * s AS DOUBLE) ELSE CAST(words * w AS DOUBLE) / CAST(units AS DOUBLE) END AS target,
        CASE WHEN s = 0 THEN 0 WHEN 3 * s * units < words * w THEN 12884901888 ELSE words * w * 4294967296 // (units * s) END AS step
    FROM sources CROSS JOIN chosen
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 16 + CAST(floor(size * 16 / pow(2.0, length(bin(size)) - 1)) AS INTEGER),
        substr(hash, 1, 2), size, hash, doc_id) - 1 AS place FROM rows
)
SELECT p.doc_id, p.size, CAST(g.s AS BIGINT) AS source_size, g.target,
    CAST(p.size * (((CAST(p.place AS HUGEINT) * g.step + CAST('0x' || substr(md5('mix:' || coalesce('s' || p.source, '')), 1, 8) AS BIGINT)) % 4294967296 + g.step) // 4294967296) AS BIGINT) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""
