from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hazeline.llm import mixing
from tests.oracle import compare, duck


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    capped, rest = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = float(most * sizes[s])
            rest -= capped[s]


def test_targets_and_copies(odd):
    rows = mixing.mixed(odd).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    expected = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    assert len(rows) == odd.count()


def test_words_come_near_the_target(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 37 % 300)), "hot" if k % 3 else f"s{k % 21}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    by = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in by:
        assert r.taken == pytest.approx(r.target, rel=0.02)
    again = mixing.mixed(docs.repartition(2)).select("doc_id", "copies")
    assert sorted(again.collect()) == sorted(mixing.mixed(docs).select("doc_id", "copies").collect())


def test_mixture_repeats_rows(odd, none):
    counts = mixing.mixed(odd).agg(F.sum("copies")).first()[0]
    mixture = mixing.mixture(odd)
    assert mixture.columns == odd.columns and mixture.count() == counts
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0


def test_hot_cell_and_no_words(spark):
    docs = spark.createDataFrame([(k, "a b c", "s") for k in range(500)] + [(900 + k, "", "empty") for k in range(5)], "doc_id bigint, text string, source string")
    by = {r.source: (r.taken, r.target) for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    assert by["empty"] == (0, 0.0) and abs(by["s"][0] - by["s"][1]) <= 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from hazeline.llm.queries import ORACLES, QUERIES

    assert compare(QUERIES["op9_systematic_mix"](spark, f"/root/testdata/{sf}"), ORACLES["op9_systematic_mix"], duck(f"/root/testdata/{sf}")) == []
