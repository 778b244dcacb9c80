"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its maximum, so half as many hash evaluations are
needed as values. Six values make a band, 48 bands a signature (24 of minima, 24 of maxima): two sets at similarity 0.8 share no
band with probability (1 - 0.8**6)**48 < 5e-7. Links are confirmed on the full sets.

Texts with equal sets are one node. Each bucket has one hub, its node with the most bucket fellows, and every node of the bucket is first tried against
the hub: a group of copies becomes one component by as many pairs as it has members. A hub's fellows that are still apart then
meet in blocks of bounded size, where an inverted index gives the exact intersections of what is outside the hub's largest component
with all others; only links come out, one for each outsider and component.

Nulls and texts without words have no set and stand alone. Repeated rows, repeated ids and null ids are allowed: rows with
equal sets share a node, and a component is named by its least id (null if it has none). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.arrays import mix, signed, slices, utf8, windows, word_hashes
from hazeline.llm.components import components
from hazeline.llm.tables import rest_of, written

BANDS, ROWS = 48, 6
_PERMUTATIONS = BANDS * ROWS // 2
#: Of 256 one-bit signature values, fewer equal ones than this have a chance under 1e-9 at similarity 0.8.
LEAST_EQUAL_BITS = 197


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n-word shingles in order; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    if len(words) < n:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, n))


def _sets(column: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        words, first = word_hashes(data, offsets[i : j + 1], lower=True)
        yield [shingle_set(words[first[k] : first[k + 1]], n) for k in range(j - i)]


def fingerprint(x: np.ndarray) -> bytes:
    """16 bytes of a set of hashes."""
    with np.errstate(over="ignore"):
        a = mix(x + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
        b = (mix(x ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)
    return np.array([a, b ^ np.uint64(len(x))], ">u8").tobytes()


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (sets x BANDS) and sketches (sets x 4) of sets that aren't empty."""
    random = np.random.default_rng(7)
    factors = random.integers(0, 1 << 63, _PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, _PERMUTATIONS, dtype=np.uint64)
    combine = random.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    values = np.empty((2 * _PERMUTATIONS, len(sets)), np.uint64)
    permuted = np.empty_like(every)
    for k in range(_PERMUTATIONS):
        np.multiply(every, factors[k], out=permuted)
        permuted += shifts[k]
        values[k] = np.minimum.reduceat(permuted, starts)
        values[_PERMUTATIONS + k] = np.maximum.reduceat(permuted, starts)
    values = mix(values).T.copy()
    bands = (values.reshape(len(sets), BANDS, ROWS) * combine).sum(axis=2, dtype=np.uint64)
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    bits = (values[:, : 256] >> np.uint64(40)) & np.uint64(1)
    sketch = (bits.reshape(len(sets), 4, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return bands, sketch


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n, fp, sketch, bands) of each row; fp is null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(2), shingle):
                full = [k for k, s in enumerate(sets) if len(s)]
                bands, sketch, prints = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    b, s = _signatures([sets[k] for k in full])
                    for row, k in enumerate(full):
                        bands[k], sketch[k], prints[k] = signed(b[row]), signed(s[row]), fingerprint(sets[k])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())),
                ], ["doc_id", "text_hash", "n", "fp", "sketch", "bands"])
                at += len(sets)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, fp binary, sketch array<bigint>, bands array<bigint>")


def _full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(fp, items) of the wanted nodes (fp, doc_id, text_hash), from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["fp", "items"])
                at += len(sets)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    keys = wanted.select("fp", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    found = rows.join(keys, rows.doc_id.eqNullSafe(keys.id) & (rows.text_hash == keys.hash)).select("fp", "text")
    # Rows with the same id and text would give a node twice.
    return found.mapInArrow(run, "fp binary, items array<bigint>").dropDuplicates(["fp"])


def _equal_bits(a: str, b: str) -> F.Column:
    return F.lit(256) - reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(4)])


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches don't rule it out."""
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.filter(fit & (_equal_bits("sketch_a", "sketch_b") >= LEAST_EQUAL_BITS)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("fp").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")).cast("bigint"))
    return both.filter(F.col("common") * 100 >= (F.size("items_a") + F.size("items_b") - F.col("common")) * percent).select("a", "b")


#: Shingles of a block in the second step; as many again are held against it.
BLOCK_SHINGLES = 1 << 20


def _across(percent: int):
    """Links of the probes of one block with its bases, one for each probe and component."""

    def run(rows: pa.Table) -> pa.Table:
        probe = rows.column("probe").to_numpy()
        fps, roots = rows.column("fp").to_pylist(), rows.column("root").to_pylist()
        items = rows.column("items").combine_chunks()
        flat, cuts = items.values.to_numpy(), items.offsets.to_numpy()
        bases = np.flatnonzero(~probe)
        sizes = np.diff(cuts)
        owners = np.repeat(np.arange(len(bases)), sizes[bases])
        tokens = np.concatenate([flat[cuts[k] : cuts[k + 1]] for k in bases]) if len(bases) else flat[:0]
        order = np.argsort(tokens, kind="stable")
        tokens, owners, of_bases = tokens[order], owners[order], sizes[bases]
        found: list[tuple[bytes, bytes]] = []
        for k in np.flatnonzero(probe).tolist():
            own = flat[cuts[k] : cuts[k + 1]]
            lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            counts = np.zeros(len(bases), np.int64)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                if a < b:
                    counts[owners[a:b]] += 1  # a base has a shingle once
            linked, seen = np.flatnonzero(counts * 100 >= (of_bases + len(own) - counts) * percent), {roots[k]}
            for x in linked.tolist():
                base = int(bases[x])
                if roots[base] not in seen:
                    seen.add(roots[base])
                    found.append((fps[k], fps[base]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return run


def _links_across(stars: DataFrame, parts: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components among each hub's fellows."""
    fellows = stars.unionByName(stars.select("a", F.col("a").alias("b")).distinct()).join(parts, F.col("b") == F.col("node"), "left")
    fellows = written(fellows.select("a", "b", F.coalesce("root", "b").alias("root")).join(nodes.select(F.col("fp").alias("b"), "n"), "b"), "fellows")
    split = fellows.groupBy("a", "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    split = split.groupBy("a").agg(F.sum("m").alias("m"), F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("m", "n", "root")).alias("most"))
    # Two fellows have been tried already.
    hubs = split.filter("roots > 1 AND m > 2").select(
        "a", F.col("most.root").alias("main"), F.expr(f"n div {BLOCK_SHINGLES} + 1").alias("blocks"), F.expr(f"(n - most.n) div {BLOCK_SHINGLES} + 1").alias("probe_blocks"),
    )
    inside = fellows.join(hubs, "a").withColumn("mark", F.xxhash64("b"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("probe_blocks") - 1)
    bases = inside.select("a", "b", "root", F.pmod("mark", "blocks").alias("block"), F.explode(every).alias("probe_block"), F.lit(False).alias("probe"))
    outside = inside.filter("root <> main")
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    probes = outside.select("a", "b", "root", F.explode(every).alias("block"), F.pmod("mark", "probe_blocks").alias("probe_block"), F.lit(True).alias("probe"))
    rows = bases.unionByName(probes).join(sets, F.col("b") == F.col("fp")).select("a", "block", "probe_block", "probe", "fp", "root", "items")
    return rows.groupBy("a", "block", "probe_block").applyInArrow(_across(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp, root, component_id) of each row of docs (doc_id, text). Similarities under 80 percent need other bands."""
    if percent < 80:
        raise ValueError("the bands are made for a similarity of 80 percent or more")
    rows = written(signatures(docs, shingle), "signatures")
    first = Window.partitionBy("fp").orderBy("doc_id", "text_hash")
    nodes = rows.filter("fp IS NOT NULL").withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")
    # The bands of a node are read where its row lies; they are most of the table.
    entries = nodes.select(F.explode("bands").alias("bucket"), "fp")
    nodes = written(nodes.drop("bands"), "nodes")
    # Buckets of one node link nothing.
    shared = entries.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    members = written(entries.join(shared, "bucket").select("bucket", "fp", "m"), "members")
    weights = members.groupBy("fp").agg(F.sum("m").alias("weight"))
    weighted = members.join(weights, "fp").select("bucket", "fp", "weight")
    hubs = weighted.groupBy("bucket").agg(F.max(F.struct("weight", "fp")).alias("hub")).select("bucket", F.col("hub.fp").alias("a"))
    stars = written(members.join(hubs, "bucket").select("a", F.col("fp").alias("b")).filter("a <> b").distinct(), "stars")
    wanted = nodes.join(weights.select("fp"), "fp").select("fp", "doc_id", "text_hash")
    sets = written(_full_sets(docs, wanted, shingle), "sets")
    known = nodes.select("fp", "n", "sketch")
    a, b = (known.select(*(F.col(c).alias(d) for c, d in (("fp", x), ("n", f"n_{x}"), ("sketch", f"sketch_{x}")))) for x in "ab")
    links = written(_confirmed(_plausible(stars.join(a, "a").join(b, "b"), percent), sets, percent), "links")
    more = _links_across(stars, components(links), nodes, sets, percent)
    parts = written(components(links.unionByName(more)), "parts")
    rooted = rows.drop("bands", "sketch").join(parts, rows.fp == parts.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    names = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("named"))
    named = rooted.join(names, "root", "left")
    return named.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "fp", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near copies: of each component the row with the least id (then text hash), once. Texts without words all stay."""
    found = near_duplicates(docs, shingle, percent)
    alone = found.filter("root IS NULL").select("doc_id", "text_hash", F.lit(False).alias("__key_once"))
    one = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    one = one.select("best.doc_id", "best.text_hash", F.lit(True).alias("__key_once"))
    keys = one.unionByName(alone).distinct().select(F.col("doc_id").alias("__key_id"), F.col("text_hash").alias("__key_hash"), "__key_once")
    hashed = docs.withColumn("__key_text", F.xxhash64("text"))
    kept = hashed.join(keys, hashed.doc_id.cast("bigint").eqNullSafe(keys["__key_id"]) & (hashed["__key_text"] == keys["__key_hash"]))
    # A row that repeats another in id and text is a copy of it.
    rank = F.row_number().over(Window.partitionBy("__key_id", "__key_hash").orderBy(rest_of(docs)))
    return kept.withColumn("__key_rank", rank).filter("NOT __key_once OR __key_rank = 1").select(*docs.columns)
