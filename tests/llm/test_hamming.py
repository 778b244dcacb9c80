import numpy as np
from pyspark.sql import functions as F

from hazeline.llm import hamming
from tests.oracle import compare, duck


def brute(rows, queries, k):
    def bits(v):
        return tuple(x is not None and x == x and x > 0 for x in v)

    known = sorted({(i, bits(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for q, code in known:
        if q in queries:
            near = sorted((sum(a != b for a, b in zip(code, other, strict=False)) + sum(code[len(other) :]) + sum(other[len(code) :]), i) for i, other in known)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def check(spark, rows, queries, k):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, code string").repartition(3)
    found = [tuple(r) for r in hamming.top_k(frame, F.col("vec_id").isin(queries), k).collect()]
    assert sorted(found) == brute(rows, queries, k)


def test_clusters_ties_and_copies(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(5, 64))
    rows = [(k, [float(x) for x in (centres[k % 5] + random.normal(size=64) * 0.5)]) for k in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(40)] + [(0, rows[0][1]), (7, [float("nan")] * 64), (None, rows[1][1]), (8, None), (9, [None, 1.0] * 32)]
    check(spark, rows, [0, 50, 1000, 7, 9, 8], 10)


def test_longer_and_shorter_vectors(spark):
    random = np.random.default_rng(2)
    rows = [(k, [float(x) for x in random.normal(size=100 if k % 4 else 70)]) for k in range(60)]
    check(spark, rows, [0, 3], 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(k, [1.0, -1.0, 0.0, float(k)]) for k in range(4)]
    check(spark, rows, [0, 1], 10)
    check(spark, rows, [99], 10)
    check(spark, [], [1], 10)


def test_sql(spark):
    from hazeline.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op5_multi_index_top_k"](spark, sf), ORACLES["op5_multi_index_top_k"], duck(sf)) == []
