"""The pipeline's stages, each judged on what it was given, by brute force."""

from collections import Counter

import corpus_pipeline as cp
from quarry.llm.common import documents, written
from quarry.llm.packing import CAPACITY
from tests.llm.test_exact_dedup import plain
from tests.llm.test_packing import check
from tests.llm.test_similar_sets import plain_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has too few toxic documents to learn from
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs, kept = documents(spark, sf), []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        kept.append(docs.collect())
        assert name == "packing" or docs.columns == COLUMNS
    start = documents(spark, sf).collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic}
    clean, exact, near, mixed, packed = kept
    gone = {r.doc_id for r in start} - {r.doc_id for r in clean}
    assert len(gone) < 0.25 * len(start) and len(toxic & gone) >= 0.6 * len(toxic)

    groups = plain((r.doc_id, r.text) for r in clean)
    assert {r.doc_id for r in exact} == {min(g)[1] for g in groups.values()} and len(exact) == len(groups)

    assert sorted(r.doc_id for r in near) == plain_kept({r.doc_id: r.text for r in exact})[0]

    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in near} and max(copies.values()) <= 2
    words = {r.doc_id: len(r.text.encode().split()) for r in near}
    assert abs(sum(words[i] * n for i, n in copies.items()) - 1.5 * sum(words.values())) < 0.1 * sum(words.values())

    check(packed, CAPACITY)
    assert sum(r.n_words for r in packed) == sum(words[i] * n for i, n in copies.items())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_run_is_the_stages_in_turn(spark, sf):
    assert cp.run(spark, sf).count() > 0 and cp.ORACLE_SQL is None
