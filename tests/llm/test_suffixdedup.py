import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from hazeline.llm import suffixdedup
from hazeline.llm.suffixarray import permuted_prefixes, suffix_array
from tests.llm.conftest import prose
from tests.oracle import compare, duck

LAST = (1 << 63) - 1


def brute(rows):
    texts = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first, out = {}, []
    for o, b in sorted(texts):
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], o)
    for o, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < o:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((None if o == LAST else o, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r, base = random.Random(1), prose(1, 200)
    rows = [(1, base), (2, base), (2, base), (2, prose(2, 50) + base[100:400]), (None, base[:60]), (None, base[:60] + prose(9, 30)), (3, None), (4, ""), (5, "x" * 5000), (6, "y" + "x" * 3000)]
    rows += [(7, "ab" * 2000), (8, "ab" * 1000 + "c"), (0, prose(3, 100)), (9, "é" * 40), (10, "zé" + "é" * 30), (11, base[:49]), (12, base[:50]), (13, base[:51] + "!")]
    for k in range(40):
        a = r.randrange(1000)
        rows.append((20 + k, prose(100 + k % 5, r.randrange(1, 60)) + " " + base[a : a + r.randrange(300)]))
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 17, 300, 20])
def test_brute_force(spark, shard_bytes):
    """Also with shards so small that anchors are split by their windows."""
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id bigint, text string, k int, o int, h int").repartition(3)
    assert sorted((tuple(r) for r in suffixdedup.deduplicated(frame, shard_bytes).collect()), key=str) == brute(rows)


def test_odd_and_empty(odd, none):
    """Texts of megabytes, a slice at a time; what is kept has the hash that is told."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in suffixdedup.deduplicated(odd).collect()), key=str)
    assert [(r[0], r[1]) for r in got] == sorted(((d, len((t or "").encode())) for d, t in rows), key=lambda x: next(str(g) for g in got if g[:2] == x))
    assert sorted((d, hashlib.sha256(k).hexdigest()) for d, k in suffixdedup.kept_texts(odd).filter("doc_id IS NOT NULL").collect()) == sorted((g[0], g[4]) for g in got if g[0] is not None)
    assert suffixdedup.deduplicated(none).count() == 0


def test_long_texts_match_across_slices(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 1000)
    rows = [(1, prose(1, 900)), (2, prose(2, 10) + prose(1, 900)[37:]), (3, prose(4, 700))]
    assert sorted((tuple(r) for r in suffixdedup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str) == brute(rows)


def test_suffix_array():
    random_ = np.random.default_rng(0)
    for _ in range(400):
        t = random_.integers(0, int(random_.integers(1, 5)), int(random_.integers(1, 60))).astype(np.uint8)
        b = t.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])  # noqa: B023
        assert suffix_array(t).tolist() == want == suffix_array(t.astype(np.int64)).tolist()
        shared, padded = permuted_prefixes(t, np.array(want), 20), b + bytes(40)
        for i, j in zip(want[1:], want):
            assert shared[i] == next((n for n in range(20) if padded[i + n] != padded[j + n]), 20)


def lines_run(f, *args):
    """What f returns, and how many lines of this subpackage ran for it."""
    n = 0

    def trace(frame, event, arg):
        nonlocal n
        n += event == "line"
        return trace if "hazeline" in frame.f_code.co_filename else None

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        return f(*args), n
    finally:
        sys.settrace(before)


def test_shards_are_sorted_by_arrays():
    """Not item by item: a shard of variants of a few texts, whose substrings repeat."""
    r = random.Random(5)
    base = [prose(k, 12)[:100] for k in range(40)]
    texts = list(dict.fromkeys((b[: (at := r.randrange(20, 80))] + "#" + b[at + 1 :]).encode() for b in base for _ in range(20)))
    ids = np.array([r.randrange(100) for _ in texts])
    (text, first, end, least), n = lines_run(suffixdedup.least_ids, texts, ids)
    assert n < len(b"".join(texts)) // 4
    holders = {}
    for x, i in zip(texts, ids.tolist()):
        for k in range(len(x) - 49):
            holders[x[k : k + 50]] = min(i, holders.get(x[k : k + 50], i))
    got = [(t, w, i) for t, a, b, i in zip(text.tolist(), first.tolist(), end.tolist(), least.tolist()) for w in range(a, b)]
    assert got == [(t, k, holders[x[k : k + 50]]) for t, x in enumerate(texts) for k in range(len(x) - 49)]


@pytest.mark.parametrize(("cached", "sliced"), [(1 << 16, 4 << 20), (1 << 16, 100), (200, 1000), (1, 100)])
def test_anchors_of_many_texts_are_those_of_each(monkeypatch, cached, sliced):
    monkeypatch.setattr(suffixdedup, "CACHED_BYTES", cached)
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", sliced)
    texts = [b"", b"a" * 49, prose(1, 40).encode(), b"b" * 50, b"", b"x" * 700, prose(2, 8).encode()[:50], b"xy" * 300, b"z"] * 30
    ends = np.cumsum([0, *map(len, texts)])
    (h, first, n, count), lines = lines_run(suffixdedup._text_anchors, np.frombuffer(b"".join(texts), np.uint8), ends)
    each = [suffixdedup._text_anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    for k, x in enumerate((h, first, n, count)):
        assert x.tolist() == np.concatenate([e[k] for e in each]).tolist()
    assert all(sum(e[2]) == max(len(t) - 49, 0) for e, t in zip(each, texts))
    assert cached < 1 << 16 or sliced < 4 << 20 or lines < 10 * len(texts)


def test_a_slice_does_not_send_a_row_for_each_bucket(monkeypatch):
    """Buckets grow with the input, so that rows of each slice for each bucket would grow with its square."""
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 2000)
    texts = [prose(k % 90, 30) for k in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["k", "text"])
    sent = list(suffixdedup._sent(70)(iter([batch] * 2)))
    assert sum(b.num_rows for b in sent) <= 2 * 70 and len(sent) <= 4
    table = pa.Table.from_batches(sent).sort_by("bucket")
    got = pa.Table.from_batches(suffixdedup._shared(iter(table.to_batches())))
    assert set(got.column("k").to_pylist()) >= {*range(10), *range(90, 100)}  # copies of one another


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from hazeline.llm.queries import ORACLES, QUERIES

    assert compare(QUERIES["op13_suffix_array_dedup"](spark, f"/root/testdata/{sf}"), ORACLES["op13_suffix_array_dedup"], duck(f"/root/testdata/{sf}")) == []
