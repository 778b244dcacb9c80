"""Exact top-k search in Hamming space by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is positive, 64 to a word. Codes are cut into segments of 16 bits, and the index has a row
for each distinct code and segment. Round r probes every segment with the values that differ in exactly r bits; after it, all codes within
segments * (r + 1) - 1 bits have been met. Every code met is verified by its full distance, at once dropped if it is beyond the k-th best so far, and a query
ends when its k-th distance lies within what is covered. Equal codes are one entry with their k least ids, which is all a top-k can show of them.

Distances tie by id. Rows without an id or a vector, and repeated (id, code) rows, take no part or one part; a missing or not-a-number value is an
unset bit; shorter vectors have unset bits at the end. With fewer than k rows all are returned; without queries or rows nothing is. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.tables import written

SEGMENT = 16


def code(vector: str, words: int) -> Column:
    """The code of a vector column as an array of words."""
    bit = f"if(coalesce({vector}[i + 64 * w] > 0 AND NOT isnan({vector}[i + 64 * w]), false), shiftleft(1L, i), 0L)"
    inside = f"aggregate(sequence(0, 63), 0L, (acc, i) -> acc | if(i + 64 * w < size({vector}), {bit}, 0L))"
    return F.expr(f"transform(sequence(0, {words - 1}), w -> {inside})")


def distance(a: Column, b: Column, words: int) -> Column:
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for w in range(1, words):
        total = total + F.bit_count(a[w].bitwiseXOR(b[w]))
    return total


def _segments(words: int) -> Column:
    """(segment, value) of a column named code."""
    return F.expr(f"transform(sequence(0, {words * 4 - 1}), s -> struct(s AS segment, cast(shiftrightunsigned(code[s div 4], {SEGMENT} * (s % 4)) & 65535 AS int) AS value))")


def _masks(weight: int) -> Column:
    """All 16-bit numbers with so many bits, as a constant."""
    text = ",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(SEGMENT), weight))
    return F.split(F.lit(text), ",").cast("array<int>")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", ident: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query row, by distance, then id."""
    rows = vectors.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull())
    bits = rows.agg(F.max(F.size(vector))).first()[0] or 0
    words = max(1, -(-bits // 64))
    segments, k_all = words * 4, k
    coded = written(rows.select(F.col(ident).alias("id"), is_query.alias("query"), code(f"`{vector}`", words).alias("code")).distinct(), "codes")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    least = coded.withColumn("place", rank).filter(F.col("place") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = written(least, "entries")
    index = written(entries.select("code", "ids", F.inline(_segments(words))), "index")
    asked = coded.filter("query").select("code").distinct()
    asked = written(asked.select(F.col("code").alias("q")), "queries")
    queries = asked.count()
    k = min(k_all, coded.count())
    if not queries:
        return coded.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(ident), F.lit(1).alias("distance"))
    left, best, finished = asked.withColumn("most", F.lit(64 * words)), None, []
    for radius in range(SEGMENT + 1):
        probes = left.select("q", "most", F.col("q").alias("code")).select("q", "most", F.inline(_segments(words)))
        probes = probes.withColumn("mask", F.explode(_masks(radius))).select("q", "most", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        far = distance(F.col("q"), F.col("code"), words)
        # Spark takes the exploded probes for as small as the queries; without the hint it would broadcast them.
        met = probes.join(index.hint("merge"), ["segment", "value"]).filter(far <= F.col("most")).select("q", far.alias("distance"), "ids")
        # A code may be met through several segments and rounds.
        met = met.select("q", "distance", F.explode("ids").alias("id"))
        every = met if best is None else best.join(left.select("q"), "q").select("q", "distance", "id").unionByName(met)
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        best = written(every.distinct().withColumn("place", place).filter(F.col("place") <= k), f"best{radius}")
        kth = best.filter(F.col("place") == k).select("q", F.col("distance").alias("kth"))
        covered = segments * (radius + 1) - 1
        done = kth.filter(F.col("kth") <= covered).select("q")
        finished.append(best.join(done, "q"))
        left = written(left.select("q").join(kth, "q", "left").filter(F.col("kth").isNull() | (F.col("kth") > covered)).select("q", F.coalesce("kth", F.lit(64 * words)).alias("most")), "left")
        if not left.count():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    asking = coded.filter("query").select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    return out.join(asking, "q").select("query_id", F.col("place").alias("rank"), F.col("id").alias(ident), F.col("distance").cast("int").alias("distance"))


ORACLE = """
WITH pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (v.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
    FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM placed WHERE rank <= 10
"""
