import random

import numpy as np

import corpus_pipeline as cp
from quarry.llm import similar_sets as ss
from quarry.llm.near_dedup import near_dedup


def plain_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def plain_kept(texts, least=0.8):
    ids, sets = sorted(texts), {i: plain_set(t) for i, t in texts.items()}
    part = {i: i for i in ids}
    pairs = 0
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                pairs += 1
                x, y = sorted((part[a], part[b]))
                part = {i: x if p == y else p for i, p in part.items()}
    return sorted(set(part.values())), pairs


def planted():
    """Texts of 60 to 200 words with near copies on both sides of 0.8, a chain whose ends are far apart, and texts with one common part."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(25):
        words = [word() for _ in range(rng.randrange(60, 200))]
        out.append(words)
        for changes in (1, 2, 3, 4, 6):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(12):
        out.append(list(chain))
        chain[rng.randrange(100)] = word()
    common = [word() for _ in range(60)]
    out += [common + [word() for _ in range(40)] for _ in range(30)]
    return {i: " ".join(w) for i, w in enumerate(out)}


def test_stage_keeps_one_of_each_five_word_group(spark):
    texts = planted()
    want, pairs = plain_kept(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(cp.STAGES)["near_dedup"](spark, docs, None)
    assert pairs > 100 and sorted(r.doc_id for r in kept.collect()) == want


def test_members_that_miss_both_ends(spark):
    # every text shares its list's bands with others of its own part and of other parts
    texts = {i: t for i, t in planted().items() if i >= 150}
    rows = {r.doc_id: r.component_id for r in ss.similar_rows(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), least=0.5).collect()}
    assert sorted(set(rows.values())) == plain_kept(texts, 0.5)[0]


def test_odd_and_empty(odd, empty):
    rows = ss.similar_rows(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 10)} == {1} and {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    kept = near_dedup(odd, shingle=5, similarity=0.8)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 11]
    assert near_dedup(empty, shingle=5, similarity=0.8).collect() == []


def test_fingerprints_are_those_of_the_drawn_shingles():
    # over half of the bits of the three shingles that come first by the fingerprint's own hash
    rng = np.random.default_rng(5)
    hashes = np.unique(rng.integers(0, 2**63, 700, np.uint64))
    for i, got in enumerate(ss.fingerprints(hashes).tolist()):
        drawn = [min(hashes.tolist(), key=lambda h: h * f % 2**64) for f in ss._FACTORS[i * ss.DRAWN : (i + 1) * ss.DRAWN].tolist()]
        assert got % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in drawn) > len(drawn))
    assert (ss.fingerprints(hashes[:1]).view(np.uint64) == hashes[0]).all()
    alike = [len(set(ss.fingerprints(hashes).tolist()) & set(ss.fingerprints(np.sort(np.append(hashes[k:], hashes[:k] + np.uint64(1)))).tolist())) for k in range(1, 78)]
    assert min(alike) > 0  # similarities of 0.8 and more


def test_stage_goes_through_the_operators_index(spark, monkeypatch):
    # fingerprints in the index are every one of the sets', and what it links decides which sets are candidates
    texts = {i: t for i, t in planted().items() if i < 30}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    asked = []
    monkeypatch.setattr(ss, "link_fingerprints", lambda prints, real=ss.link_fingerprints: asked.append({r.fp for r in prints.collect()}) or real(prints))
    kept = dict(cp.STAGES)["near_dedup"](spark, docs, None)
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(texts)[0]
    assert asked == [{p for t in texts.values() for p in ss.fingerprints(ss.shingle_set(t)).tolist()}]


def test_index_links_fingerprints_two_bits_apart(spark):
    # in the index these are three nodes, of which two are linked
    prints = spark.createDataFrame([(0b1011 << 40,), (0b1000 << 40,), (0b0111 << 40,), ((1 << 62) - 1,)], "fp long")
    assert {tuple(sorted((r.a >> 40, r.b >> 40))) for r in ss.link_fingerprints(prints).collect()} == {(0b1000, 0b1011), (0b0111, 0b1011)}
