import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from hazeline.llm import prefixtrie, sketch
from tests.oracle import compare, duck


def brute(rows):
    """The contract read literally, over whole conversations in memory."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(role, text) for _, _, role, _, text in sorted(v)] for c, v in turns.items()}
    members, rebuilt, children = defaultdict(list), {}, defaultdict(set)
    for conv, own in said.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = said.get(conv - int(math.fmod(conv, 20)), [])[:h] + own[h:]
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[c] for c in children[path])
        ends = ",".join(str(c) for c in sorted(c for c in members[path] if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rows = [(None, 1, "user", "nowhere"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "a b"), (-3, 1, "user", "minus"), (-20, 2, "user", "a b"), (-20, 1, "", "x")]
    rows += [(c, t, "user" if t % 2 else "bot", f"turn {t} of all") for c in range(40, 60) for t in range(c % 7)]  # copies and prefixes of one another
    rows += [(c, t, "user", f"own {c}" if t > 1 else "hello there") for c in range(100, 180) for t in range(4)]
    rows += [(200, t, "user", f"long {t}") for t in range(3000)] + [(201, t, "user", f"long {t}") for t in range(3000)] + [(220 + k, 0, "user", "x" * 200_000) for k in range(2)]
    return [*rows, (300, 5, "a", "tie one"), (300, 5, "a", "tie two"), (300, 5, "A", "tie two"), (301, 1, "only", "base is missing")]


@pytest.mark.parametrize("cells", [None, 1 << 15, 64])
def test_brute_force(spark, monkeypatch, cells):
    """Whatever the sketch lets through: as it is, small, and so full that every prefix seems shared."""
    if cells:
        monkeypatch.setattr(prefixtrie, "width", lambda n: cells if cells >= sketch._BLOCK else sketch._BLOCK)
    if cells == 64:
        monkeypatch.setattr(prefixtrie, "repeated_cells", lambda df, digest, wide: b"\xff" * (sketch.ROWS * wide // 8))
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string, x1 int").repartition(3)
    assert sorted((tuple(r) for r in prefixtrie.trie(frame).collect()), key=str) == brute(rows)


def test_empty(spark):
    frame = spark.createDataFrame([(None, 1, "user", "nowhere")], "conv_id bigint, turn bigint, role string, text string")
    assert prefixtrie.trie(frame).count() == 0 and prefixtrie.trie(frame.limit(0)).count() == 0
    alone = spark.createDataFrame([(23, 0, "u", "t")], frame.schema)  # its head is that of a conversation that isn't there
    assert sorted((tuple(r) for r in prefixtrie.trie(alone).collect()), key=str) == brute([(23, 0, "u", "t")])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from hazeline.llm.queries import ORACLES, QUERIES

    assert compare(QUERIES["op11_prefix_trie"](spark, f"/root/testdata/{sf}"), ORACLES["op11_prefix_trie"], duck(f"/root/testdata/{sf}")) == []
