from collections import Counter

import corpus_pipeline
from hazeline.llm import secrets as S
from tests.llm.test_mixing import water
from tests.llm.test_neardup import WORD, brute
from tests.llm.test_packing import check
from tests.llm.test_perplexity import expected

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [c for *_, c in seen[:-1]] == [columns] * 4

    _, before, after, _ = seen[0]
    verdicts = expected(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if verdicts[r.doc_id][2]}

    _, before, after, _ = seen[1]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in before], 5)})

    _, before, after, _ = seen[2]
    masked = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        spans = S.base_spans(r.text)
        text = masked[r.doc_id].text
        assert (text == r.text) == (not spans) and not S.base_spans(text) and masked[r.doc_id].n_chars == len(text)

    _, before, after, _ = seen[3]
    sizes, taken = Counter(), Counter()
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    for r in before:
        sizes[r.source] += size[r.doc_id]
    for r in after:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in after).values()) <= 3
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= 3 * max(n for r in before if r.source == source for n in [size[r.doc_id]])

    check(seen[4][2], [(r.doc_id, r.text) for r in seen[4][1]], corpus_pipeline.packing.CAPACITIES)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "n_tokens", "bin_id", "bin_capacity", "bin_offset"] and rows.count() > 100
