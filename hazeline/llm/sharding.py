"""Sharding by extendible hashing; DataFrame functions only.

A row's bits are the MD5 of its key, then of its whole content, then of its position, 384 in all. The directory is indexed by a prefix of the bits and
only a bucket over the byte limit is split on another bit. Sixteen bits are decided at a time from byte sums per 16-bit cell, which are exact at every
depth; only cells still over the limit go on to the next sixteen. Rows with one key and over the limit part by content, and equal
rows by position, so a key with a third of all rows is split like any other bucket.

A bucket of one row may exceed the limit; it can't be split. Null keys hash as a value of their own; null texts have 0 bytes; an empty
table gives no rows. Only the key columns, the text and the content hash are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.llm.tables import written

CELL = 16
_PART = 8  # cells of each MD5


def _md5(columns: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns)))


def assigned(docs: DataFrame, key: Sequence[str] = ("doc_id",), limit_bytes: int = 64 << 20) -> DataFrame:
    """(key columns, bytes, shard, depth) of each row. shard: hex of the whole sixteens of its prefix, a colon, the bits after them."""
    bits = F.concat(_md5(key), _md5(docs.columns), F.md5(F.monotonically_increasing_id().cast("string")))
    rows = written(docs.select(*key, F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("shard_bytes"), bits.alias("shard_bits")), "bits")
    done, rest, at = [], rows, 0
    while True:
        stem, piece = F.substring("shard_bits", 1, 4 * at), F.conv(F.substring("shard_bits", 4 * at + 1, 4), 16, 10).cast("int")
        rest = rest.withColumn("stem", stem).withColumn("piece", piece)
        part = F.substring("shard_bits", 32 * (at // _PART) + 1, 32)
        cells = rest.groupBy("stem", "piece").agg(F.sum("shard_bytes").alias("size"), F.count("*").alias("n"), F.min(part).alias("lo"), F.max(part).alias("hi"))
        cells = written(cells, "cells")
        # Every prefix of a cell; at depth 0 only in the first round, as later stems are over the limit.
        prefixes = cells.select("stem", "piece", "size", "n", F.explode(F.sequence(F.lit(0 if at == 0 else 1), F.lit(CELL))).alias("d"))
        prefixes = prefixes.withColumn("prefix", F.expr(f"shiftright(piece, {CELL} - d)"))
        sums = prefixes.groupBy("stem", "d", "prefix").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        fit = sums.filter((F.col("size") <= limit_bytes) | (F.col("n") == 1))
        # The shortest prefix that fits is the bucket; prefixes of a cell fit from some depth on.
        leaves = prefixes.select("stem", "piece", "d", "prefix").join(fit.select("stem", "d", "prefix"), ["stem", "d", "prefix"])
        leaves = leaves.groupBy("stem", "piece").agg(F.min("d").alias("d"))
        leaves = written(leaves, "leaves")
        bit = F.substring(F.lpad(F.bin("piece"), CELL, "0"), F.lit(1), F.col("d"))
        found = rest.join(leaves, ["stem", "piece"]).withColumn("shard", F.concat("stem", F.lit(":"), bit)).withColumn("depth", F.col("d") + CELL * at)
        done.append(found.select(*key, "shard_bytes", "shard", "depth"))
        over = cells.join(leaves, ["stem", "piece"], "left_anti").select("stem", "piece", "lo", "hi")
        left, mixed = over.agg(F.count("*"), F.count(F.when(F.col("lo") != F.col("hi"), 1))).first()
        if not left:
            break
        rest = written(rest.join(over.select("stem", "piece"), ["stem", "piece"]).drop("stem", "piece"), "over")
        # Where all that is left agrees in the rest of this hash, its cells have nothing to tell apart.
        at = at + 1 if mixed else (at // _PART + 1) * _PART
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("shard_bytes", "bytes")


#: For limits that sixteen bits reach.
ORACLE = """
WITH rows AS (
    SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS bytes,
        CAST('0x' || substr(md5(coalesce('v' || CAST(doc_id AS VARCHAR), '')), 1, 4) AS INTEGER) AS piece FROM documents
), prefixes AS (
    SELECT doc_id, bytes, piece, CAST(d AS INTEGER) AS d, piece >> (16 - CAST(d AS INTEGER)) AS prefix FROM rows CROSS JOIN range(0, 17) t(d)
), sums AS (
    SELECT d, prefix, sum(bytes) AS size, count(*) AS n FROM prefixes GROUP BY d, prefix
)
SELECT p.doc_id, CAST(any_value(p.bytes) AS BIGINT) AS bytes, ':' || substr(lpad(bin(any_value(p.piece)), 16, '0'), 1, min(p.d)) AS shard, min(p.d) AS depth
FROM prefixes p JOIN sums s ON p.d = s.d AND p.prefix = s.prefix
WHERE s.size <= {limit} OR s.n = 1
GROUP BY p.doc_id
"""
