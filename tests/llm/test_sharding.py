import hashlib

import pytest
from pyspark.sql import functions as F

from hazeline.llm import sharding
from tests.oracle import compare, duck


def brute(rows, limit):
    """Splits (bits, bytes) rows bit by bit; returns the prefix of each."""
    out = [None] * len(rows)
    todo = [("", list(range(len(rows))))]
    while todo:
        prefix, own = todo.pop()
        if sum(rows[k][1] for k in own) <= limit or len(own) == 1:
            for k in own:
                out[k] = prefix
        else:
            for bit in "01":
                part = [k for k in own if rows[k][0][len(prefix)] == bit]
                if part:
                    todo.append((prefix + bit, part))
    return out


def bits_of(shard):
    stem, _, rest = shard.partition(":")
    return "".join(f"{int(c, 16):04b}" for c in stem) + rest


@pytest.mark.parametrize("limit", [100, 2_000, 10**9])
def test_equals_brute_force(spark, limit):
    rows = [(k, "x" * (k * 31 % 97)) for k in range(3000)]
    found = {r.doc_id: r for r in sharding.assigned(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], limit).collect()}
    bits = ["".join(f"{int(c, 16):04b}" for c in hashlib.md5(f"v{k}".encode()).hexdigest()) for k, _ in rows]
    expected = brute(list(zip(bits, [len(t) for _, t in rows], strict=True)), limit)
    for (k, _), prefix in zip(rows, expected, strict=True):
        assert bits_of(found[k].shard) == prefix and found[k].depth == len(prefix)


def test_limit_holds_for_a_hot_key_and_equal_rows(spark):
    rows = [(7, f"text {k}") for k in range(400)] + [(8, "same")] * 400 + [(k, "y" * 50) for k in range(100, 300)] + [(9, "z" * 5000)]
    found = sharding.assigned(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), ["doc_id"], 300)
    assert found.count() == len(rows)
    by = found.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r.bytes <= 300 or r.n == 1 for r in by)


def test_odd_rows(odd, none):
    found = sharding.assigned(odd, ["doc_id"], 1000)
    assert found.count() == odd.count()
    by = found.groupBy("shard").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r.bytes <= 1000 or r.n == 1 for r in by)
    assert sharding.assigned(none).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (20_000, 64 << 20):
        assert compare(sharding.assigned(docs, ["doc_id"], limit), sharding.ORACLE.format(limit=limit), duck(sf)) == []
