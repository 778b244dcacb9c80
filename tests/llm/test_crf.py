import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazeline.llm import crf


def test_marginals_equal_enumeration():
    random = np.random.default_rng(2)
    lines = np.array([3, 0, 1, 5, 2])
    odds, pair = random.normal(size=lines.sum()), random.normal(size=(2, 2))
    good, pairs, _ = crf.marginals(odds, lines, pair)
    at = 0
    for k, n in enumerate(lines):
        weights, marginal, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(odds[at + t] * y for t, y in enumerate(labels)) + sum(pair[a, b] for a, b in itertools.pairwise(labels)))
            weights += w
            marginal += w * np.array(labels)
            for a, b in itertools.pairwise(labels):
                both[a, b] += w
        assert np.allclose(good[at : at + n], marginal / weights) and np.allclose(pairs[k], both / weights)
        at += n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = crf.classified(docs, labels).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in found)
    out = [r for r in found if r.held_out]
    good, bad = ([r for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.99 and np.mean([r.predicted for r in bad]) < 0.1


def test_labels_of_the_held_out_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(crf.classified(docs, labels).collect()) == sorted(crf.classified(docs, turned).collect())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 6, 8, 9, 11)] + [(4, 1), (1, 1), (None, 1), (12, None)], "doc_id bigint, quality int")
    found = crf.classified(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    same = {}
    for r, text in zip(sorted(found, key=lambda r: str(r.doc_id)), sorted(odd.collect(), key=lambda r: str(r.doc_id)), strict=True):
        if text.doc_id == 2:
            same.setdefault(r.score, 0)
    assert len(same) == 1
    assert crf.classified(none, labels).count() == 0
    no_labels = crf.classified(odd, labels.filter("quality = 7")).collect()
    assert {r.score for r in no_labels} == {0.5}


def test_long_text_is_scored_whole(monkeypatch):
    model = {"share": 0.5, "weights": np.random.default_rng(1).normal(size=crf.N_WEIGHTS), "pair": np.eye(2), "curve": (1.0, 0.0)}
    text = "\n".join(f"Line {k} has words, and they end." for k in range(400))
    whole = crf.scores(pa.array([text, None, ""]), model)
    assert whole[1] == whole[2] and len(whole) == 3
    monkeypatch.setattr(crf, "BLOCK", 1500)
    assert crf.scores(pa.array([text]), model)[0] == pytest.approx(whole[0], abs=0.3)


def test_marginals_of_long_chains(monkeypatch):
    random = np.random.default_rng(3)
    lines = np.array([3, 0, 90, 1, 300, 0])
    odds, pair = random.normal(scale=9, size=lines.sum()), random.normal(size=(2, 2))
    doubled = crf.marginals(odds, lines, pair)
    monkeypatch.setattr(crf, "LOOP", 1000)
    for a, b in zip(doubled, crf.marginals(odds, lines, pair), strict=True):
        assert np.allclose(a, b)


def test_whole_texts_are_learned_from(spark):
    """Good and bad documents differ after their hundredth line only."""
    same = "\n".join(f"Line {k} has words, and they end." for k in range(100))
    tails = ["\n".join(f"### {k} BUY NOW!!! | MENU | $$$" for k in range(100)), "\n".join(f"More about number {k} is told here." for k in range(100))]
    docs = spark.createDataFrame([(k, f"{same}\n{tails[k % 2]}") for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    score = {r.doc_id: r.score for r in crf.classified(docs, labels).collect()}
    assert all(score[k] > 0.8 if k % 2 else score[k] < 0.2 for k in range(60))
    weights = crf.train(docs, labels)["weights"]
    calls = int(crf._FIRST[list(crf.EDGES).index("calls")])
    assert weights[calls + 1 : calls + len(crf.EDGES["calls"]) + 1].min() < -0.1  # no line of the first hundred has calls
