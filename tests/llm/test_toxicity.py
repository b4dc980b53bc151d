import math
import pickle
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from quarry.llm import toxicity as tx
from quarry.llm.common import documents, remainder_of


def sparse(raw):
    norm = math.sqrt(sum(x * x for x in raw.values()))
    ids = sorted(raw)
    return np.array(ids, np.int64), np.array([raw[t] / norm for t in ids])


@pytest.mark.parametrize("size, k", [(0, 3), (1, 3), (127, 10), (700, 10), (700, 690), (700, 800)])
def test_index_is_exact(size, k):
    rng = random.Random(3)
    vectors = [sparse({min(400, int(rng.paretovariate(0.5))): rng.random() + 0.1 for _ in range(rng.randrange(1, 12))}) for _ in range(size)]
    index = tx.BlockMaxIndex(vectors, 401)
    queries = [*vectors[:60], (np.empty(0, np.int64), np.empty(0))]
    for (ids, q), (cosines, near) in zip(queries, index.nearest(queries, k)):
        mine = dict(zip(ids.tolist(), q.tolist()))
        true = np.array([sum(x * mine.get(t, 0) for t, x in zip(*(a.tolist() for a in v))) for v in vectors])
        best = sorted((e for e in range(size) if true[e] > 0), key=lambda e: -true[e])[:k]
        assert len(near) == len(set(near.tolist())) == len(best)
        assert np.allclose(cosines, true[best], atol=1e-5) and np.allclose(cosines, true[near], atol=1e-5)
        assert all((-a, i) < (-b, j) for a, b, i, j in zip(cosines, cosines[1:], near, near[1:]))


def test_index_skips_blocks():
    # each block has a topic of its own; one term is in a few examples of all blocks
    rng = random.Random(5)
    vectors = [sparse({1 + 8 * (e // tx.BLOCK) + i: 1.0 for i in rng.sample(range(8), 3)} | ({0: 0.3} if e % 32 == 0 else {})) for e in range(2560)]
    index = tx.BlockMaxIndex(vectors, 161)
    read, real = [], index._spread
    index._spread = lambda start, length: read.append(int(length.sum())) or real(start, length)
    index.nearest(vectors[:1], 16)
    here = sum(int(index.length[index.runs[t] : index.runs[t + 1]].sum()) for t in vectors[0][0].tolist())
    assert (index.row < 0).all() and here > 1.2 * sum(read[1:])  # the first call lists runs


def plain_terms(text):
    words = regex.findall(r"\p{L}+", (text or "").lower())
    return Counter(words) + Counter(w[:4] + "-" for w in set(words) if len(w) > 4)


def plain_isotonic(v, y, w):
    """The minimax formula over the different votes."""
    at = sorted(set(v))
    sums = [(sum(b * c for a, b, c in zip(v, y, w) if a == x), sum(c for a, c in zip(v, w) if a == x)) for x in at]
    rate = lambda i, j: sum(s for s, _ in sums[i : j + 1]) / sum(c for _, c in sums[i : j + 1])
    return at, [max(min(rate(i, j) for j in range(n, len(at))) for i in range(n + 1)) for n in range(len(at))]


def test_isotonic():
    rng = random.Random(8)
    v, y = [round(rng.random(), 1) for _ in range(60)], [rng.randrange(2) for _ in range(60)]
    w = [rng.choice((1.0, 3.0)) for _ in v]
    at, rates = plain_isotonic(v, y, w)
    x, fitted = tx.isotonic(np.array(v), np.array(y, float), np.array(w))
    assert all(a < b for a, b in zip(x, x[1:])) and all(a < b for a, b in zip(fitted, fitted[1:]))
    assert np.allclose(sorted({round(r, 9) for r in rates}), fitted)
    for value in fitted:  # a knot stands at its pool's mean vote
        pool = [(a * c, c) for a, c in zip(v, w) if abs(rates[at.index(a)] - value) < 1e-9]
        assert np.isclose(sum(p for p, _ in pool) / sum(c for _, c in pool), x[list(fitted).index(value)])


def test_query_is_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None and remainder_of(r.doc_id, 5)}
    # at this size LEAST lets every labelled row in
    assert len(labels) <= tx.LEAST
    terms = {i: plain_terms(t) for i, t in docs.items()}
    df = Counter(t for c in terms.values() for t in c)
    known = set().union(*(terms[i] for i in labels))

    def vector(i):
        raw = {t: (1 + math.log(n)) * math.log((len(docs) + 1) / df[t]) for t, n in terms[i].items() if t in known}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    vectors = {i: vector(i) for i in docs}
    cosine = lambda a, b: sum(x * vectors[b].get(t, 0.0) for t, x in vectors[a].items())
    even = sum(labels.values()) / len(labels)

    def vote(i, k, leave=None):
        near = sorted(((cosine(i, e), e) for e in labels if e != leave), reverse=True)[:k]
        near = [(s, e) for s, e in near if s > 1e-6]
        return (sum(s * labels[e] for s, e in near) + tx.PRIOR * even) / (sum(s for s, _ in near) + tx.PRIOR)

    best = (-1.0, None, None)
    y = list(labels.values())
    for k in tx.NEAREST:
        v = [vote(i, k, leave=i) for i in labels]
        x, rates = tx.isotonic(np.array(v), np.array(y, float), np.ones(len(v)))
        said = np.interp(v, x, rates) >= 0.5
        f1 = 2 * sum(a for s, a in zip(said, y) if s) / (said.sum() + sum(y))
        if f1 > best[0] + 1e-9:
            best = f1, k, (x, rates)
    _, k, knots = best
    model = tx.fit(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.k == k and np.allclose(model.knots[1], knots[1], atol=1e-4)
    for r in tx.op2_toxicity(spark, sf).collect():
        want = np.interp(vote(r.doc_id, k), *knots)
        assert abs(r.score - want) < 2e-3, (r, want)
        assert r.predicted == (r.score >= 0.5) and r.held_out == (remainder_of(r.doc_id, 5) == 0)
        assert bool(r.evidence) == any(cosine(r.doc_id, e) > 1e-6 for e in labels)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(3 * toxic):
            text[rng.randrange(60)] = rng.choice(("rotten", "filthxx", "filthyy", "filthzz"))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    truth = {i: any(w in t for w in ("rotten", "filth")) for i, t in docs}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = tx.toxicity_rows(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (remainder_of(r.doc_id, 5) == 0) for r in rows)
    assert len([r for r in rows if r.predicted != truth[r.doc_id]]) <= 15
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_do_not_matter(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = [r.doc_id for r in labels.collect() if remainder_of(r.doc_id, 5) == 0]
    turned = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(tx.toxicity_rows(docs, labels).collect()) == sorted(tx.toxicity_rows(docs, turned).collect())


def test_odd_and_empty(odd, empty, labels, spark):
    rows = tx.toxicity_rows(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score is not None for r in rows)
    assert tx.toxicity_rows(empty, labels).collect() == []
    none = labels.limit(0)
    assert {r.score for r in tx.toxicity_rows(odd, none).collect()} == {0.0}
    assert tx.drop_toxic(odd, none).columns == odd.columns
    assert sorted(map(str, tx.drop_toxic(odd, none).collect())) == sorted(map(str, odd.collect()))
    clash = spark.createDataFrame([("a b", 1, "x", 3)], "text string, doc_id long, `ro``w` string, score int")
    assert tx.drop_toxic(clash, none).collect() == clash.collect()
    assert tx.score_texts(clash, tx.fit(clash, none)).columns == ["text", "doc_id", "ro`w", "score", "evidence"]


def test_one_label_and_long_text(spark):
    docs = spark.createDataFrame([(1, "bad words"), (2, "some words"), (3, "word " * 400_000 + "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, toxic int")
    assert {r.score for r in tx.toxicity_rows(docs, labels).collect()} == {1.0}


def test_terms():
    texts = ["  The the, THEORY's theorem_theorem 12²x", None, "", "é ß 日本語 naïveté", "word " * 400_000 + "bad"]
    terms, text, term, n = tx.term_counts(pa.array(texts))
    got = [Counter() for _ in texts]
    for i, t, k in zip(text.tolist(), term.tolist(), n.tolist()):
        got[i][terms[t]] += k
    assert got == [plain_terms(t) for t in texts] and len(set(zip(text, term))) == len(text)
    assert [len(x) for x in tx.term_counts(pa.array([], pa.string()))] == [0, 0, 0, 0]


def test_a_vocabulary_is_held_without_an_object_for_each_term():
    sent = pickle.dumps(tx.Vocabulary(pa.array([f"term{i}" for i in range(200_000)]), np.arange(200_000), 200_000))
    tracemalloc.start()
    held = pickle.loads(sent)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000
    assert [i.tolist() for i, _ in held.vectors(pa.array(["term no Term7 term199999", None]))] == [[], []]
    assert tx.places(["term7", "no", "term199999"], held.terms).tolist() == [7, -1, 199_999] and tx.places([], held.terms).tolist() == []
