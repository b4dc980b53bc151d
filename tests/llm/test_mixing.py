import random
from collections import defaultdict

import pytest

from quarry.llm import mixing as mx


def plain_targets(sizes):
    """Shares by weight; what is above twice a source's size is shared again among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= set(above)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{rng.randrange(1000)}": rng.choice((0, 1, 5, 100, 3000)) for _ in range(rng.randrange(1, 12))} | ({None: 77} if seed % 2 else {})
    rows = mx.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    assert {r.source: r.source_size for r in rows} == sizes
    assert {r.source: r.target for r in rows} == pytest.approx(plain_targets(sizes))


def test_contract(spark, sf, texts):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = mx.op10_mixing(spark, sf).collect()
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[sources[i]] += len((t or "").encode().split())
    target, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert (r.size, r.source_size, r.target) == (len((texts[r.doc_id] or "").encode().split()), sizes[sources[r.doc_id]], pytest.approx(target[sources[r.doc_id]]))
        assert r.taken in (0, r.size, 2 * r.size)
        taken[sources[r.doc_id]] += r.taken
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.05 * sum(sizes.values())
    assert sorted(rows) == sorted(mx.op10_mixing(spark, sf).collect())


def test_near_target_on_many_documents(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text", "concat('s', id % 4) AS source")
    rows = mx.mix_rows(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] / r["max(target)"] - 1) < 0.02 for r in rows)
    assert mx.mix(docs).count() == mx.mix_rows(docs).agg({"copies": "sum"}).head()[0]


def test_odd_and_empty(odd, empty):
    rows = mx.mix_rows(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r.size for r in rows)
    assert mx.mix(odd).columns == odd.columns and mx.mix(odd).count() == sum(r.copies for r in rows)
    assert mx.mix_rows(empty).collect() == [] and mx.mix(empty).collect() == []
