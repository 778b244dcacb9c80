"""Suffix-array dedup: bytes covered by a string of 50 bytes that also starts in a document with a smaller id are removed.

Sharding by anchors. The least hash of the 24-byte strings within each 50 bytes is their anchor; equal strings have equal anchors, so they meet where anchors
do. Consecutive windows with one anchor are one segment (about 14 windows). Anchors of one document only are dropped first: tasks send packed hashes by
bucket, one entry for an anchor that several documents of a slice have, so that a very common anchor costs an entry a slice. Anchors are cut to 48 bits and
names of texts to 40 there: what collides is looked at in vain and no more, for windows are compared by their bytes. Then equal segments
are merged with the least id of each. An anchor with one text has nothing to compare; the different texts of all other anchors are dealt into shards of
bounded size, each sorted by induced sorting, and neighbours that share 50 bytes, by their permuted common prefixes, form a group with one least id. An anchor
whose texts alone exceed eight shards is split by its windows, each grouped whole.

Null texts are empty; a null id counts as greater than all others. Rows with equal ids don't remove from one another, and repeated rows give equal results. Texts of any length are
read whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.arrays import mix, slices, utf8
from hazeline.llm.suffixarray import permuted_prefixes, suffix_array
from hazeline.llm.tables import discarded, released

LENGTH, _GRAM = 50, 24
_WINDOW = LENGTH - _GRAM + 1
#: Windows in a segment.
MOST_WINDOWS = 64
#: Bytes of text whose anchors share a bucket, bytes handled at a time, and bytes of a shard.
BUCKET_BYTES, SLICE_BYTES, SHARD_BYTES = 16 << 20, 4 << 20, 1 << 17
#: Bytes of short texts whose anchors are found together.
CACHED_BYTES = 1 << 16
#: Bytes of text whose anchors are packed at a time: a row for each bucket, and buckets grow with the input.
PACKED_BYTES = 16 << 20
#: Rows sent to Spark at a time.
ROWS = 64
#: An anchor whose texts are longer than so many shards is split by its windows.
ANCHOR_SHARDS = 8
_LAST = (1 << 63) - 1
#: Bytes of an anchor and of a text's name in what tasks send.
_ANCHOR, _NAME = 6, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEY = "o bigint, h bigint"


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD + b
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every segment of texts that lie one after the other, and each text's number of segments."""
    size = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not size.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    h = data[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    for step in (1, 2, 4):
        h = _joined(h[:-step], h[step:])
    h = mix(_joined(_joined(h[:-16], h[8:-8]), h[16:]))
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    h = np.minimum(h[: len(h) - (_WINDOW - 16)], h[_WINDOW - 16 :])
    # Windows that reach into the next text are left out.
    ends = np.cumsum(size)
    begins = ends - size
    if len(size) > 1:
        h = np.concatenate([h[x : x + k] for x, k in zip((offsets[:-1] - offsets[0]).tolist(), size.tolist(), strict=True) if k])
    cut = np.concatenate([[True], h[1:] != h[:-1]])
    cut[begins[size > 0]] = True
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(h)))
    if int(n.max()) > MOST_WINDOWS:  # periodic text; where it is cut doesn't matter, as windows are compared one by one
        pieces = -(-n // MOST_WINDOWS)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, n = np.repeat(first, pieces) + step * MOST_WINDOWS, np.minimum(np.repeat(n, pieces) - step * MOST_WINDOWS, MOST_WINDOWS)
    count = np.diff(np.searchsorted(first, np.append(begins, len(h))))
    return h[first], first - np.repeat(begins, count), n, count


def _text_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of any length, a few at a time that stay in the processor's cache, or a slice of one; a segment may be cut in two there."""
    found = []
    for i, j in slices(offsets, min(CACHED_BYTES, SLICE_BYTES)):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= SLICE_BYTES:
            found.append(anchors(data, offsets[i : j + 1]))
            continue
        parts = []
        for at in range(a, b - LENGTH + 1, SLICE_BYTES):
            h, first, n, _ = anchors(data, np.array([at, min(at + SLICE_BYTES + LENGTH - 1, b)]))
            parts.append((h, first + at - a, n))
        h, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found.append((h, first, n, np.array([len(h)])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    o, text = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), F.coalesce("text", F.lit(""))
    return docs.select(o.alias("o"), F.xxhash64(text).alias("h"), F.xxhash64(o, text).bitwiseAND(F.lit((1 << 8 * _NAME) - 1)).alias("k"), text.alias("text"))


_PACKED = "bucket int, anchors binary, names binary, offs binary, ns binary, many binary, sure boolean"
#: Bytes of each packed number: anchor, name, first window, windows.
_WIDTHS = (_ANCHOR, _NAME, 5, 1)


def _pack(bucket: int, x: list[np.ndarray], many: np.ndarray, sure: bool) -> tuple:
    """A row of numbers byte by byte, all lowest bytes first: high bytes of small numbers become runs of zeros."""
    return bucket, *(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for a, w in zip(x, _WIDTHS, strict=True)), many.tobytes(), sure


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 5, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _PACKED.split(", ")])


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _sent(buckets: int):
    """Anchors of whole texts, packed by bucket: entries to compare, and the segments already known to share their anchor within what is packed at a time."""

    def packed(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, name, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        h, first, n, name = h[order], first[order], n[order], name[order]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(cuts, len(h)))
        sure = np.repeat(np.minimum.reduceat(name, cuts) < np.maximum.reduceat(name, cuts), size)
        lead = np.zeros(len(h), bool)
        lead[cuts] = True
        bucket = h % buckets
        for which, known in ((~sure | lead, False), (sure, True)):
            at = np.flatnonzero(which)
            at = at[np.argsort(bucket[at], kind="stable")]
            edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                own = at[edges[b] : edges[b + 1]]
                rows.append(_pack(b, [h[own], name[own], first[own], n[own]], sure[own], known))
                if len(rows) == ROWS:
                    yield _packed_rows(rows)
                    rows = []
            if rows:
                yield _packed_rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                h, first, n, count = _text_anchors(data, offsets[i : j + 1])
                found.append(((h & np.uint64((1 << 8 * _ANCHOR) - 1)).astype(np.int64), np.repeat(names[i:j], count), first, n))
                size += int(offsets[j] - offsets[i])
                if size >= PACKED_BYTES:
                    yield from packed(found)
                    found, size = [], 0
        if found:
            yield from packed(found)

    return run


_SEGMENT = "anchor bigint, k bigint, off bigint, n bigint"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments whose anchor several documents have. Rows come by bucket."""
    names = ["anchor", "k", "off", "n"]

    def segments(x: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(at), 1 << 16):
            part = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c[part]) for c in x], names)

    def settle(rows: list[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = [np.concatenate([r[0][k] for r in rows]) for k in range(4)]
        many = np.concatenate([r[1] for r in rows])
        order = np.argsort(x[0], kind="stable")
        h, name, m = x[0][order], x[1][order], many[order]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        several = (np.minimum.reduceat(name, cuts) < np.maximum.reduceat(name, cuts)) | np.logical_or.reduceat(m, cuts)
        keep = np.repeat(several, np.diff(np.append(cuts, len(h)))) & ~m  # entries that stand for many came with their segments
        yield from segments(x, order[keep])

    bucket, rows = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            x = [_unpack(batch.column(k + 1)[r].as_py(), w) for k, w in enumerate(_WIDTHS)]
            if batch.column(6)[r].as_py():
                yield from segments(x, np.arange(len(x[0])))
                continue
            b = batch.column(0)[r].as_py()
            if b != bucket and rows:
                yield from settle(rows)
                rows = []
            bucket = b
            rows.append((x, np.frombuffer(batch.column(5)[r].as_py(), bool)))
    if rows:
        yield from settle(rows)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment of a text with the hash of its bytes; the bytes themselves once in a batch."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        listed = batch.column(3)
        cuts = listed.offsets.to_numpy().tolist()
        anchor, off, n = (listed.values.field(k).to_numpy() for k in range(3))
        os, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # Texts whose names collide are given each other's segments.
        sizes = pc.binary_length(batch.column(2).cast(pa.binary())).to_numpy()
        fits = off + n + LENGTH - 1 <= np.repeat(sizes, np.diff(listed.offsets.to_numpy()))
        cuts = np.concatenate([[0], np.cumsum(fits)])[cuts].tolist()
        anchor, off, n = anchor[fits], off[fits], n[fits]
        a = 0
        while a < len(os):
            segs: list[int] = []
            bodies: list[bytes | None] = []
            size, b = 0, a
            while b < len(os) and size < SLICE_BYTES and len(segs) < 1 << 15:
                data, own = batch.column(2)[b].as_buffer().to_pybytes(), slice(cuts[b], cuts[b + 1])
                for key, first, end in zip(anchor[own].tolist(), off[own].tolist(), (off[own] + n[own] + LENGTH - 1).tolist(), strict=True):
                    body = data[first:end]
                    seg = xxhash.xxh3_64_intdigest(body) - (1 << 63)
                    segs.append(seg)
                    if (key, seg) in seen:
                        bodies.append(None)
                    else:
                        seen.add((key, seg))
                        bodies.append(body)
                        size += len(body)
                b += 1
            own, count = slice(cuts[a], cuts[b]), np.diff(cuts[a : b + 1])
            columns = [pa.array(anchor[own]), pa.array(segs, pa.int64()), *(pa.array(np.repeat(x[a:b], count)) for x in (os, hs)), pa.array(off[own]), pa.array(n[own]), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "o", "h", "off", "n", "body"])
            a = b


_OCCURRENCE = f"anchor bigint, seg bigint, {_KEY}, off bigint, n bigint, body binary"


def least_ids(texts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """Runs of windows of the texts (text, first, end, least id): the least id of the texts that hold the window."""
    joined = np.frombuffer(b"\xff".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(joined)
    # Neighbours that share fewer bytes part two groups; between them all suffixes have the same window.
    group = np.cumsum(permuted_prefixes(joined, sa, LENGTH)[sa] < LENGTH)
    owners = np.repeat(np.arange(len(texts)), sizes + 1)
    owner = owners[sa]
    window = sa - starts[owner] + LENGTH <= sizes[owner]
    sa, group, owner = sa[window], group[window], owner[window]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.empty(len(joined), np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(ids[owner], cuts), np.diff(np.append(cuts, len(sa))))
    own = np.sort(sa)
    owner, least = owners[own], least[own]
    opens = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])]))
    closes = np.append(opens[1:], len(own)) - 1
    return [owner[opens], own[opens] - starts[owner[opens]], own[closes] + 1 - starts[owner[closes]], least[opens]]


def _sorted_shard(table: pa.Table) -> pa.Table:
    text, *runs = least_ids(table.column("body").to_pylist(), table.column("least").to_numpy())
    return pa.table([pa.array(x) for x in (*(table.column(c).to_numpy()[text] for c in ("anchor", "seg")), *runs)], _RUNS)


_RUNS = ["anchor", "seg", "first", "end", "least"]


def _window_runs(occurrences: DataFrame, shard_bytes: int) -> DataFrame:
    """(anchor, seg, first, end, least): the least id of the documents that hold each window of each different segment."""
    texts = released(occurrences.groupBy("anchor", "seg").agg(F.min("o").alias("least"), F.min("n").alias("n")), "texts")
    per_anchor = texts.groupBy("anchor").agg(F.count("*").alias("m"), F.sum(F.col("n") + LENGTH).alias("bytes"))
    of_anchor = released(texts.join(per_anchor, "anchor").select("anchor", "seg", "least", "n", F.when(F.col("m") > 1, F.col("bytes")).alias("bytes")), "of_anchor")
    discarded(texts)
    single = of_anchor.filter("bytes IS NULL").select("anchor", "seg", F.lit(0).cast("bigint").alias("first"), F.col("n").alias("end"), "least")
    several = of_anchor.filter("bytes IS NOT NULL").select("anchor", "seg", "least", "bytes")
    bodies = occurrences.filter("body IS NOT NULL").select("anchor", "seg", "body").join(several, ["anchor", "seg"])
    bodies = released(bodies.dropDuplicates(["anchor", "seg"]), "bodies")
    total = bodies.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    shards = total // shard_bytes + 1
    dealt = bodies.filter(F.col("bytes") <= ANCHOR_SHARDS * shard_bytes).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    arrays = dealt.select("shard", "anchor", "seg", "least", "body").groupBy("shard").applyInArrow(_sorted_shard, ", ".join(f"{c} bigint" for c in _RUNS))
    windows = bodies.filter(F.col("bytes") > ANCHOR_SHARDS * shard_bytes).withColumn("first", F.explode(F.sequence(F.lit(0), F.length("body") - LENGTH)))
    windows = windows.select("anchor", "seg", F.col("first").cast("bigint").alias("first"), "least", F.md5(F.expr(f"substring(body, first + 1, {LENGTH})")).alias("window"))
    least = windows.groupBy("window").agg(F.min("least").alias("window_least"))
    split = windows.join(least, "window").select("anchor", "seg", "first", (F.col("first") + 1).alias("end"), F.col("window_least").alias("least"))
    runs = released(single.select(*_RUNS).unionByName(arrays).unionByName(split), "runs")
    discarded(of_anchor, bodies)
    return runs


def _spans(listed: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """Starts and ends of the maximal spans that each row's ranges cover, and the index of each row's first span (one more than rows)."""
    offsets, flat = listed.offsets.to_numpy(), listed.values
    rows = np.repeat(np.arange(len(listed)), np.diff(offsets)) << 40
    at = slice(int(offsets[0]), int(offsets[-1]))
    first, end = (flat.field(k).to_numpy()[at] + rows for k in range(2))
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order]) if len(end) else end
    opens = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]])) if len(end) else np.zeros(0, np.int64)
    closes = np.append(opens[1:] - 1, len(reach) - 1) if len(opens) else opens
    starts, ends, low = first[opens], reach[closes], (1 << 40) - 1
    return (starts & low).tolist(), (ends & low).tolist(), np.searchsorted(starts >> 40, np.arange(len(listed) + 1)).tolist()


def removed_ranges(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(o, h, first, end): byte ranges of the documents (doc_id, text) to remove; they may overlap. Rows are named by o, the id, and h, the xxhash64 of their text."""
    keyed = _keyed(docs)
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = size // BUCKET_BYTES + 1
    packed = keyed.select("k", "text").mapInArrow(_sent(buckets), _PACKED)
    shared = released(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, _SEGMENT), "segments")
    listed = shared.groupBy("k").agg(F.collect_set(F.struct("anchor", "off", "n")).alias("listed"))
    texts = keyed.join(listed, "k").select("o", "h", "text", "listed")
    # A repeated row repeats its segments, no more.
    occurrences = released(texts.mapInArrow(_bodies, _OCCURRENCE), "occurrences")
    discarded(shared)
    runs = _window_runs(occurrences, shard_bytes)
    hits = occurrences.select("anchor", "seg", "o", "h", "off").join(runs, ["anchor", "seg"]).filter("least < o")
    ranges = released(hits.select("o", "h", (F.col("off") + F.col("first")).alias("first"), (F.col("off") + F.col("end") + LENGTH - 1).alias("end")), "ranges")
    discarded(occurrences, runs)
    return ranges


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        starts, ends, cuts = _spans(batch.column(2))
        for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            data = text.as_buffer().to_pybytes()
            spans = list(zip(starts[cuts[k] : cuts[k + 1]], ends[cuts[k] : cuts[k + 1]], strict=True))
            chain, at = hashlib.sha256(), 0
            for a, b in spans:
                chain.update(data[at:a])
                at = b
            chain.update(data[at:])
            rows.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), chain.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_ranges(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(doc_id, text, ranges) of each row of docs."""
    listed = removed_ranges(docs, shard_bytes).groupBy("o", "h").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))
    rows = _keyed(docs).withColumn("doc_id", F.when(F.col("o") < _LAST, F.col("o")))
    return rows.join(listed, ["o", "h"], "left").select("doc_id", "text", "ranges")


def deduplicated(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text)."""
    return _with_ranges(docs, shard_bytes).mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept_texts(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, kept): what is left of each row's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            starts, ends, cuts = _spans(batch.column(2))
            for k, text in enumerate(batch.column(1)):
                data, own = text.as_buffer().to_pybytes(), slice(cuts[k], cuts[k + 1])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *ends[own]], [*starts[own], len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return _with_ranges(docs, shard_bytes).mapInArrow(run, "doc_id bigint, kept binary")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM d, range(0, greatest(n - {LENGTH - 1}, 0)) AS r(p)),
first_of AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT w.doc_id, p FROM w JOIN first_of f ON f.s = w.s WHERE first_id < w.doc_id),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + {LENGTH} AS b FROM numbered GROUP BY doc_id, k),
gaps AS (
  SELECT d.doc_id, s.a, substr(d.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0))) AS part
  FROM spans s JOIN d ON d.doc_id = s.doc_id
  UNION ALL SELECT d.doc_id, d.n + 1, substr(d.h, 2 * coalesce(max(s.b), 0) + 1) FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id, d.n, d.h),
kept AS (SELECT doc_id, sha256(unhex(string_agg(part, '' ORDER BY a))) AS kept_sha256 FROM gaps GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(s.a)::BIGINT AS n_spans, any_value(kept_sha256) AS kept_sha256
FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id, d.n"""
