import re
from collections import Counter, defaultdict

from hazeline.llm import packing


def brute(lengths, capacities, cost):
    """Best-fit decreasing one item at a time; the opening rule is the library's. Contents of the bins."""
    left, bins = Counter(lengths), []
    for length in sorted(left, reverse=True):
        count = left.pop(length)
        shorter = sorted(left)
        while count:
            best = min((b for b in bins if b[0] >= length), key=lambda b: b[0], default=None)
            if best is None:
                def price(c):
                    own = length * min(count, c // length)
                    return cost(c) / (own + packing._fill(c - own, shorter, left))

                best = [min((c for c in sorted(capacities) if c >= length), key=price), 0, []]
                bins.append(best)
            best[0] -= length
            best[2].append(length)
            count -= 1
    return bins


def test_plan_equals_brute_force():
    for seed in range(6):
        lengths = [1 + (k * k * 7919 + seed * 104729) % 60 for k in range(500)]
        slots = packing.plan(Counter(lengths), (16, 32, 64), lambda c: c + 4)
        got = defaultdict(list)
        for length, _, ranks, each, first, _, capacity in slots:
            for r in range(ranks):
                got[first + r // each].append((length, capacity))
        mine = sorted(sorted(x for x, _ in b) for b in got.values())
        assert mine == sorted(sorted(b[2]) for b in brute(lengths, (16, 32, 64), lambda c: c + 4))
        for items in got.values():
            content = sum(x for x, _ in items)
            assert {c for _, c in items} == {min(c for c in (16, 32, 64) if c >= content)}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs, capacities):
    total = Counter()
    bins = defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is None:
            assert r.n_tokens == 0 and r.piece is None
        else:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_capacity))
    expected = Counter()
    for doc_id, text in docs:
        expected[doc_id] += words(text)
    assert +total == +expected
    for items in bins.values():
        at = 0
        for offset, n, _ in sorted(items):
            assert offset == at
            at += n
        assert {c for _, _, c in items} == {min(c for c in capacities if c >= at)}
    return bins


def test_odd_rows(odd, none):
    rows = packing.packed(odd, (64, 128, 512)).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], (64, 128, 512))
    assert sum(r.n_tokens == 0 for r in rows) == 4
    assert packing.packed(none).count() == 0


def test_hot_length(spark):
    docs = [(k, "w " * (30 if k % 2 else 1 + k % 90)) for k in range(4000)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6), (64, 128, 256)).collect()
    bins = check(rows, docs, (64, 128, 256))
    used, room = sum(n for b in bins.values() for _, n, _ in b), sum(b[0][2] for b in bins.values())
    assert used / room > 0.97


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.packed(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], packing.CAPACITIES)
