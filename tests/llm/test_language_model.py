import math
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quarry.llm import language_model as lm
from quarry.llm.common import remainder_of


def test_gradients_are_those_of_differences():
    net = lm.Network(11, units=5, classes=3)
    for w in net.weights:
        net.weights[w] = net.weights[w].astype(np.float64)
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (6, 4))
    y = rng.integers(0, 11, (6, 4))
    h0 = rng.normal(0, 0.3, (4, 5))

    def loss():
        h, out = h0, 0.0
        for t in range(6):
            h = np.where((x[t] == net.symbols)[:, None], 0, h)
            h = net.step(h, x[t])[0]
            out -= net.log_probabilities(h, y[t]).mean() / 6
        return out

    grads, _ = net._gradients(h0, x, y)
    for name, w in net.weights.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 15)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=2e-6), (name, at)


def test_probabilities_add_up_to_one():
    net = lm.Network(37, units=6, classes=5)
    net.start_biases(np.arange(37.0))
    h = np.random.default_rng(9).normal(0, 1, (3, 6)).astype(np.float32)
    total = sum(np.exp(net.log_probabilities(h, np.full(3, s))) for s in range(37))
    assert total == pytest.approx(np.ones(3), rel=1e-5)


def test_state_is_carried_over_windows_and_cleared_between_documents():
    net = lm.Network(50, units=8, classes=6)
    rng = np.random.default_rng(10)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (1, 5, 400, 33, 32, 31, 64)]
    plain = []
    for t in texts:
        h, out, last = np.zeros((1, 8), np.float32), 0.0, net.symbols
        for s in t:
            h = net.step(h, np.array([last]))[0]
            out += float(net.log_probabilities(h, np.array([s]))[0])
            last = s
        plain.append(out)
    for lanes in (1, 2, 3, 7):
        assert net.score(texts, lanes=lanes) == pytest.approx(plain, rel=1e-4)


def test_tokens():
    texts = ["", None, "  A b\tÄ\x0bb \n", "x", "\x1c y\xa0z"]
    words, bounds, token = lm.tokens(pa.array(texts))
    got = [[words[t] for t in token[i:j]] for i, j in zip(bounds, bounds[1:])]
    assert got == [[w.lower() for w in (t or "").encode().split()] + [b" "] for t in texts]
    assert lm.tokens(pa.array([], pa.string()))[1].tolist() == [0]


def test_score_holds_a_window_at_a_time():
    net = lm.Network(50)
    long = np.random.default_rng(1).integers(0, 50, 200_000).astype(np.int32)
    tracemalloc.start()
    net.score([long, *(long[i : i + 1] for i in range(255))])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_scoring_holds_the_states_of_a_window_alone():
    net = lm.Network(50)
    texts = [np.random.default_rng(2).integers(0, 50, 2000).astype(np.int32)] * 256
    tracemalloc.start()
    net.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_500_000


def test_counting_costs_little_more_than_cutting():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{k:x}" for k in (400_000 * rng.random(500) ** 2).astype(int)) for _ in range(2000)])

    def seconds(f):
        def one():
            begin = time.thread_time()
            f()
            return time.thread_time() - begin

        return min(one() for _ in range(3))

    cut = seconds(lambda: [pc.ascii_split_whitespace(t).values.dictionary_encode() for t in lm.by_size(texts, lm.BYTES)])
    assert seconds(lambda: list(lm._count_words([pa.record_batch([texts], names=["text"])]))) < 3 * cut


def test_each_word_is_counted_once_a_task():
    words = [f"w{i}" for i in range(250_000)]
    batch = pa.record_batch([pa.array([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])], names=["text"])
    out = pa.Table.from_batches(lm._count_words([batch, batch]))
    assert sorted(zip(out["word"].to_pylist(), out["n"].to_pylist())) == sorted([(w.encode(), 2) for w in words] + [(b" ", 1000)])


def test_counting_holds_a_bounded_number_of_bytes():
    # texts without white space, all different: words of 100,000 bytes
    batches = (pa.record_batch([pa.array([f"{i}-{k}" + "x" * 100_000 for k in range(20)])], names=["text"]) for i in range(100))
    pa.default_memory_pool().release_unused()
    begin, most, rows = pa.total_allocated_bytes(), 0, 0
    for b in lm._count_words(batches):
        most, rows = max(most, pa.total_allocated_bytes() - begin), rows + len(b)
    assert rows >= 2000 and most < 150_000_000


def test_counts_leave_the_task_in_parts_and_add_up():
    words = [f"w{i}" for i in range(700_000)]
    batches = [pa.record_batch([pa.array([" ".join(words[i : i + 500])])], names=["text"]) for i in range(0, len(words), 500)]
    c = Counter()
    for b in lm._count_words(batches + batches[:1200]):
        for w, n in zip(*(x.to_pylist() for x in b.columns)):
            c[w] += n
    assert c == Counter({w.encode(): 1 + (i < 600_000) for i, w in enumerate(words)}) + Counter({b" ": 2600})


@pytest.mark.parametrize("block", [3, 16, 1024])
def test_gradients_of_frequent_and_rare_symbols_in_blocks(monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK", block, raising=False)
    net = lm.Network(11, units=4, classes=3)
    for w in net.weights:
        net.weights[w] = net.weights[w].astype(np.float64)
    rng = np.random.default_rng(4)
    x = np.where(rng.random((5, 12)) < 0.5, 7, rng.integers(0, 12, (5, 12)))  # one symbol in over half the places
    y = rng.integers(0, 11, (5, 12))
    h0 = rng.normal(0, 0.3, (12, 4))

    def loss():
        h, out = h0, 0.0
        for t in range(5):
            h = net.step(np.where((x[t] == net.symbols)[:, None], 0, h), x[t])[0]
            out -= net.log_probabilities(h, y[t]).mean() / 5
        return out

    grads, _ = net._gradients(h0, x, y)
    for name, w in net.weights.items():
        assert grads[name].shape == w.shape
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 30)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=2e-3, abs=2e-6), (name, at)


def test_large_weights_stay_in_range():
    net = lm.Network(40, units=6, classes=5)
    rng = np.random.default_rng(5)
    for scale in (8, 14, 60):  # logits within and beyond what float32 can be raised to
        net.weights |= {k: rng.normal(0, scale, net.weights[k].shape).astype(np.float32) for k in ("c", "s")}
        h, target = rng.uniform(-1, 1, (200, 6)).astype(np.float32), rng.integers(0, 40, 200)
        cls, place = np.divmod(target, net.per)
        top = h.astype(float) @ net.weights["c"] + net.weights["cb"]
        low = (h.astype(float)[:, None] @ net.weights["s"][cls])[:, 0] + net.weights["sb"][cls]
        plain = sum(v[np.arange(200), k] - v.max(1) - np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) for v, k in ((top, cls), (low, place)))
        assert net.log_probabilities(h, target) == pytest.approx(plain, rel=1e-4, abs=1e-3)


def test_replicas_learn_from_every_document(spark, monkeypatch):
    # "c" follows "a" and "b" in turn; each word alone is as frequent as the other
    monkeypatch.setattr(lm, "SHARD", 4000)
    rows = [(i, "a c b d " * 60) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(lm, "written", lambda df, name, real=lm.written: real(df, name) if name != "encoded" else seen.append(real(df, name)) or seen[0])
    scores = {r.doc_id: (r.score, r.base_score) for r in lm.score_rows(docs).collect()}
    monkeypatch.setattr(lm, "ALL", 100)
    lm.score_rows(docs).collect()
    assert 0 < seen[1].count() < 0.5 * seen[0].count()  # beyond ALL
    fold = [i for i, _ in rows if remainder_of(i, 7) != 2]
    assert seen[0].count() == len(fold) and seen[0].select("shard").distinct().count() > 3 and seen[0].select("round").distinct().count() == lm.ROUNDS
    assert all(score > 0.6 * base for score, base in scores.values())


def test_a_large_corpus_is_learned_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "written", lambda df, name, real=lm.written: seen.append(real(df, name)) or seen[-1])
    monkeypatch.setattr(lm, "ROUNDS", 2)
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(200)], "doc_id long, text string")
    model = lm.Model([(b"a", 50), (b"b", 50)], 30_000_000, 2)  # a corpus of 30,000,000 tokens, by its counts
    start = model.network.vector()
    lm.train(model, docs)
    assert seen[0].count() == 200 and not (model.network.vector() == start).all()


def plain_symbol_logs(model, words):
    """Natural logs of the network's probabilities, a step at a time, by plain loops over its weights."""
    w, n = {k: v.astype(float) for k, v in model.network.weights.items()}, model.network.units
    h, last, out = np.zeros(n), model.network.symbols, []
    for word in words:
        a, g = w["x"][last], h @ w["u"]
        z, r = (1 / (1 + np.exp(-(a + g)[i * n : (i + 1) * n])) for i in (0, 1))
        h = (1 - z) * np.tanh(a[2 * n :] + r * g[2 * n :]) + z * h
        last = model.known.get(word, 0)
        cls, place = divmod(last, model.network.per)
        top, low = h @ w["c"] + w["cb"], h @ w["s"][cls] + w["sb"][cls]
        out.append(top[cls] - np.log(np.exp(top).sum()) + low[place] - np.log(np.exp(low).sum()))
    return out


def test_against_brute_force(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 2000)
    monkeypatch.setattr(lm, "KNOWN", 600)
    monkeypatch.setattr(lm, "TOGETHER", 20_000)
    monkeypatch.setattr(lm, "BYTES", 30_000)
    fitted = []
    monkeypatch.setattr(lm, "fit", lambda docs, real=lm.fit: fitted.append(real(docs)) or fitted[0])
    rows = sorted(lm.op6_language_model(spark, sf).collect())
    words = {i: [w.lower() for w in (t or "").encode().split()] + [b" "] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if remainder_of(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder_of(r.doc_id, 7) == 2, len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        # a token beyond the network's: P(unknown) shared out by the corpus's counts, one for a token never seen
        model = fitted[0][0]
        rest = sum(k for w, k in c.items() if w not in model.known) + sum(w not in model.known for w in c) + 1
        logs = zip(ws, plain_symbol_logs(model, ws))
        assert r.score == pytest.approx(sum(x / math.log(10) + (0 if w in model.known else math.log10((c[w] + 1) / rest)) for w, x in logs), rel=1e-4)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_and_empty(odd, empty):
    rows = lm.score_rows(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert {r.n_tokens for r in rows if r.doc_id == 6} == {30_001}
    assert lm.score_rows(empty).collect() == []
    held = odd.where("doc_id = 7").selectExpr("CAST(CASE WHEN doc_id = 7 THEN 0 END AS BIGINT) AS doc_id", "text")
    assert len(lm.score_rows(held).collect()) == 1
