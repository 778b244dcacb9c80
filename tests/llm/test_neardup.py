import re

import numpy as np
import pytest

from hazeline.llm import neardup
from hazeline.llm.components import components
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, percent=80):
    """(id, text) rows to [(number of shingles, least id reachable)]."""
    sets = []
    for _, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        sets.append(frozenset(tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(rows[x][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[x][0], len(sets[x]), rows[x][0] if not sets[x] else least[find(x)]) for x in range(len(rows))]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("shingle", [2, 5])
def test_odd_rows(odd, none, shingle):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd, shingle).collect()]
    assert order(found) == order(brute([(r.doc_id, r.text) for r in odd.collect()], shingle))
    assert neardup.near_duplicates(none, shingle).count() == 0


def edited(base, seed, share):
    """A copy with some words replaced; replacements are unlike others."""
    words = base.split()
    random = np.random.default_rng(seed)
    for at in random.choice(len(words), int(len(words) * share), replace=False):
        words[at] = f"w{seed}x{at}"
    return " ".join(words)


def test_large_group_of_near_copies(spark):
    """Copies around 0.8 of each other: some reach others only through the hub, some not at all."""
    base = prose(50, 150)
    rows = [(k, edited(base, k, 0.02 + 0.1 * (k % 10) / 10)) for k in range(160)] + [(1000 + k, prose(100 + k, 100)) for k in range(30)] + [(2000 + k, base) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()]
    expected = brute(rows, 2)
    assert order(found) == order(expected)
    assert 2 < len({c for _, _, c in expected if c < 1000})


def test_blocks_give_the_same(spark, monkeypatch):
    base = prose(50, 100)
    rows = [(k, edited(base, k, 0.02 + 0.12 * (k % 8) / 8)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 2).collect()]
    assert order(found) == order(brute(rows, 2))


def test_dedup_keeps_one_of_each(odd, none):
    kept = neardup.deduplicated(odd, 5)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in kept.select("doc_id", "text").collect())
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    texts = {len(t or "") for i, t in rows}
    assert {x for _, _, x in ids} == {t for t in texts if t != len(prose(1, 79) + " changed")} | {len(prose(1, 80))}
    assert len([x for x in ids if x[1] == 1]) == 1 and not [x for x in ids if x[1] in (2, 3, 9)]
    assert len([x for x in ids if x[2] == 0]) == 3  # empty texts all stay
    assert neardup.deduplicated(none, 5).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_min_and_max_estimate_the_similarity():
    random = np.random.default_rng(3)
    common, a, b = (random.integers(0, 1 << 62, n, dtype=np.uint64) for n in (800, 100, 100))
    bands, sketch = neardup._signatures([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))])
    equal = 256 - sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(*sketch, strict=True))
    assert 2 * equal / 256 - 1 == pytest.approx(0.8, abs=0.15)
    assert (bands[0] == bands[1]).any()
