"""The trie of conversation prefixes, screened by a count-min sketch of prefix digests.

Conversations are ordered by turn (null first; equal turns by role, then by MD5 of the text) and rebuilt: the first h turns of conversation c - c % 20, then
their own after the first h, with h = crc32(c) % 4. A prefix is known by its depth and a 128-bit digest, the XOR of hashes of (place, role, text), so digests are
running totals and no conversation has to fit into a task. Where the sketch estimates one, a prefix is proved to belong to one conversation: its node is written
where the row lies. Only prefixes that may be shared are shuffled, and grouped exactly.

A node is named by its least member, so each conversation names the nodes of a path down to its end. What a subtree holds is summed over paths: a path's total
goes to every shared prefix above its top, and along the path it is a running total from below.

Null roles and texts are empty; rows without conv_id are in no conversation. Repeated rows are turns of their own. Empty table: no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm import crcsql
from hazeline.llm.running import running
from hazeline.llm.sketch import repeated_cells, seem_repeated, width
from hazeline.llm.tables import n_words, written

#: Conversations that share their head with the first of them, and how many turns they may take of it.
FAMILY, HEADS = 20, 4
_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_CHUNK = 1 << 16


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, role_text hashes a and b, words) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.md5(text).alias("mark"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), n_words(F.col("text")).alias("words"), F.lit(1).cast("bigint").alias("one"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark")]
    return written(running(turns, "conv_id", order, {"pos": ("sum", "one")}, "turns").select("conv_id", "pos", "a", "b", "words"), "ordered")


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of every conversation, and its turns (conv_id, d, last, words, hash terms t1 and t2) as rebuilt."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("bigint")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = turns.filter(f"pos < {HEADS} AND conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    given = heads.groupBy("base").agg(F.count("*").alias("given"))
    convs = convs.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = written(convs.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    own = turns.join(convs.select("conv_id", "h", "taken", "size"), "conv_id").filter("pos > h").withColumn("d", F.col("pos") - F.col("h") + F.col("taken"))
    borrowed = convs.filter("taken > 0").select("conv_id", "base", "h", "size").join(heads, "base").filter("pos <= h").withColumn("d", F.col("pos"))
    columns = ["conv_id", "d", (F.col("d") == F.col("size")).alias("last"), "words", *(F.xxhash64(F.lit(k), "d", "a", "b").alias(f"t{k}") for k in (1, 2))]
    return convs.select("conv_id", "size"), own.select(*columns).unionByName(borrowed.select(*columns))


def _screened(paths: DataFrame, bits, wide: int) -> DataFrame:
    """Adds whether a prefix, and the one before it, may be shared."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            own, parent = (pa.array(seem_repeated(batch.column(c).to_numpy(), table, wide)) for c in ("x1", "p1"))
            yield pa.RecordBatch.from_arrays([*batch.columns, own, parent], [*batch.schema.names, "open", "parent_open"])

    return paths.mapInArrow(probe, "conv_id bigint, d bigint, last boolean, words bigint, x1 bigint, x2 bigint, p1 bigint, p2 bigint, open boolean, parent_open boolean")


def _ends(ends: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of the prefixes (x1, x2) at which conversations (conv_id) end. Ids are sorted and joined in ranges, so that a prefix of
    very many ends is hashed from few long pieces; a hash is one chain of bytes, and no more than a piece is held."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids = None, None, []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (first, pa.int64()), (",".join(ids), pa.string()))], ["x1", "x2", "first", "ids"])

        for batch in batches:
            for x1, x2, conv in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (x1, x2) != key or len(ids) >= _CHUNK:
                    if ids:
                        yield piece()
                    key, first, ids = (x1, x2), conv, []
                ids.append(str(conv))
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, None
        found: list[tuple[int, int, str]] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["x1", "x2", "ends_sha256"])

        for batch in batches:
            for x1, x2, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (x1, x2) != key:
                    if key is not None:
                        found.append((*key, chain.hexdigest()))
                    key, chain = (x1, x2), hashlib.sha256(ids.encode())
                else:
                    chain.update(b"," + ids.encode())
            if found:
                yield out()
                found = []
        if key is not None:
            found.append((*key, chain.hexdigest()))
            yield out()

    ranged = ends.select("x1", "x2", "conv_id").repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id")
    joined = ranged.mapInArrow(pieces, "x1 bigint, x2 bigint, first bigint, ids string")
    return joined.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInArrow(hashed, "x1 bigint, x2 bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of conversations (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    convs, turns = _rebuilt(_ordered(conversations))
    paths = running(turns, "conv_id", [F.col("d")], {"x1": ("bit_xor", "t1"), "x2": ("bit_xor", "t2")}, "rebuilt")
    paths = written(paths.select("conv_id", "d", "last", "words", "x1", "x2", F.col("x1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("t2")).alias("p2")), "paths")
    wide = width(paths.count())
    rows = written(_screened(paths, spark.sparkContext.broadcast(repeated_cells(paths, "x1", wide)), wide), "screened")

    empty = F.lit(hashlib.sha256(b"").hexdigest())
    # The root has every conversation and is the only node without digest.
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    top = F.lit(root.conv_id).cast("bigint")

    shared = rows.filter("open")
    groups = shared.groupBy("d", "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("parent_open").alias("parent_open"),
    )
    groups = written(groups, "groups")
    alone = rows.filter("NOT open")
    attached = alone.filter("d > 1 AND parent_open")
    children = groups.filter("d > 1").select("d", "p1", "p2").unionByName(attached.select("d", "p1", "p2"))
    children = children.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = groups.join(children, ["d", "x1", "x2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")), "nodes")

    # Each conversation's path: its top, what it saves, and whether its end is a leaf of its own.
    inner = nodes.groupBy("conv_id").agg(F.min("d").alias("top"), F.sum("gain").alias("gain"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    tails = alone.filter("last").select("conv_id", F.lit(None).cast("bigint").alias("top"), F.lit(0).cast("bigint").alias("gain"), F.lit(1).cast("bigint").alias("leaf"))
    named = inner.unionByName(tails).groupBy("conv_id").agg(F.min("top").alias("top"), F.sum("gain").alias("gain"), F.max("leaf").alias("leaf"))
    named = written(named.filter("gain > 0 OR leaf > 0"), "named")
    above = shared.select("conv_id", "d", "x1", "x2").join(named, "conv_id").filter("top IS NULL OR d < top")
    above = above.groupBy("d", "x1", "x2").agg(F.sum("gain").alias("gain_above"), F.sum("leaf").alias("leaves_above"))

    below = running(nodes.select("conv_id", "d", "x1", "x2", "gain"), "conv_id", [F.col("d").desc()], {"below": ("sum", "gain")}, "below").select("d", "x1", "x2", "below")
    turnless = convs.filter("size = 0").select(F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("x2"), "conv_id")
    ends = written(_ends(shared.filter("last").select("x1", "x2", "conv_id").unionByName(turnless)), "ends")

    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))

    def under_parent(df: DataFrame) -> DataFrame:
        """Adds the parent's name: the root's, the conversation's own where the parent is not shared, or that of the parent's group."""
        near = df.filter("d = 1").withColumn("parent_conv_id", top).unionByName(df.filter("d > 1 AND NOT parent_open").withColumn("parent_conv_id", F.col("conv_id")))
        return near.unionByName(df.filter("d > 1 AND parent_open").join(parents, ["d", "p1", "p2"]).select(*near.columns))

    single = under_parent(alone).select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", F.lit(1).cast("bigint").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    found = under_parent(nodes.select("d", "x1", "x2", "p1", "p2", "parent_open", "conv_id", "n_convs", "n_children"))
    found = found.join(below, ["d", "x1", "x2"]).join(above, ["d", "x1", "x2"], "left").join(named.select("conv_id", "leaf"), "conv_id", "left").join(ends, ["x1", "x2"], "left")
    grouped = found.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", (F.coalesce("leaf", F.lit(0)) + F.coalesce("leaves_above", F.lit(0))).alias("n_leaves"),
        (F.col("below") + F.coalesce("gain_above", F.lit(0))).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    if not root.n_convs:
        return grouped.unionByName(single).select(*_NODE)
    whole = named.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain")).first()
    first = rows.filter("d = 1 AND NOT open").agg(F.count("*")).first()[0] + groups.filter("d = 1").count()
    at_root = ends.filter("x1 = 0 AND x2 = 0").first()
    crown = [(root.conv_id, 0, None, root.n_convs, first, whole.leaves if first else 1, whole.gain, at_root.ends_sha256 if at_root else hashlib.sha256(b"").hexdigest())]
    crown = spark.createDataFrame(crown, "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
    return grouped.unionByName(single).unionByName(crown).select(*_NODE)


ORACLE = f"""
WITH {crcsql.TABLE},
turns AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, max(pos) AS n, ANY_VALUE(conv_id - conv_id % {FAMILY}) AS base FROM turns GROUP BY conv_id),
hashed AS (SELECT conv_id, n, base, {crcsql.crc32("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM convs, crc_table),
taking AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM hashed c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT c.conv_id, t.pos AS d, t.said, t.words FROM taking c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.taken, t.said, t.words FROM taking c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
paths AS (
  SELECT conv_id, d, words, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, d = max(d) OVER (PARTITION BY conv_id) AS last FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM paths GROUP BY path, d),
children AS (SELECT p.path, count(*) AS n FROM nodes p JOIN nodes c ON c.d = p.d + 1 AND starts_with(c.path, p.path) GROUP BY p.path),
subtree AS (
  SELECT p.path, sum((c.n - 1) * c.words) AS saved, count(*) FILTER (WHERE c.path NOT IN (SELECT path FROM children)) AS leaves
  FROM nodes p JOIN nodes c ON c.d >= p.d AND starts_with(c.path, p.path) GROUP BY p.path)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM nodes k JOIN subtree s ON s.path = k.path LEFT JOIN children c ON c.path = k.path LEFT JOIN nodes p ON p.d = k.d - 1 AND p.path = left(k.path, 64 * (k.d::BIGINT - 1))"""
