import random
from itertools import combinations

import numpy as np
import xxhash

from quarry.llm import near_dedup as nd
from quarry.llm.components import components


def plain_print(text):
    words = [w.lower() for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=2):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[ids[a]] ^ prints[ids[b]]).count("1") <= bits:
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, sf, texts):
    rows = nd.op7_near_dedup(spark, sf).collect()
    prints = {i: plain_print(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(11)
    prints = {}
    for _ in range(40):  # chains whose ends are far apart, links in one byte and in two
        x = rng.getrandbits(64)
        for _ in range(8):
            prints[len(prints)] = x
            for _ in range(rng.choice((0, 1, 2, 2, 3))):
                x ^= 1 << rng.randrange(64)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in set(prints.values())], "fp long")
    labels = {r.node % 2**64: r.label for r in components(nd.link_fingerprints(df)).collect()}
    want = plain_components(prints)
    for a in prints:
        for b in range(a):
            got = prints[a] == prints[b] or labels.get(prints[a], "a") == labels.get(prints[b], "b")
            assert got == (want[a] == want[b])


def test_every_pair_shares_a_key():
    keys = nd.key_positions()
    assert len(keys) == 6 and all(len(k) == 4 for k in keys)
    for two in combinations(range(8), 2):
        assert any(not set(two) & set(k) for k in keys)


def test_large_posting_list():
    base = np.arange(3000, dtype=np.uint64)  # all in one list: they differ in two bytes only
    assert len(nd.list_links(base)[0]) == 2999
    far = np.array([0, 0x0707, 0x7070], np.uint64)
    assert nd.list_links(far)[0] == []


def test_count_filter_drops_pairs():
    # one key's four bytes are shared; the other four agree now and then
    rng = np.random.default_rng(7)
    values = np.unique(rng.integers(0, 3, (500, 4), np.uint8).astype(np.uint64) @ (np.uint64(1) << np.arange(0, 32, 8, np.uint64)))
    links, (tallied, retained, verified) = nd.list_links(values)
    pairs = [(int(a), int(b)) for a in values for b in values if a < b]
    shared = [sum((a >> s & 255) == (b >> s & 255) for s in range(0, 64, 8)) for a, b in pairs]
    assert tallied == len(pairs) and retained == sum(n >= 6 for n in shared) < tallied
    assert verified == sum(bin(a ^ b).count("1") <= 2 for a, b in pairs) < retained
    half = len(values) // 2
    across, counts = nd.list_links(values[:half], other=values[half:])
    assert counts[0] == half * (len(values) - half)
    assert all(x < half <= y and bin(int(values[x]) ^ int(values[y])).count("1") <= 2 for x, y in across)


def test_long_lists_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 50)
    rng = random.Random(2)
    prints = {i: rng.getrandbits(11) for i in range(600)}
    df = spark.createDataFrame([(p,) for p in set(prints.values())], "fp long")
    labels = {r.node: r.label for r in components(nd.link_fingerprints(df)).collect()}
    want = plain_components(prints)
    assert all(labels.get(p, p) == min(prints[j] for j in prints if want[j] == want[i]) for i, p in prints.items())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (1001, 1000)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1301), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_different_texts_with_one_id_keep_their_groups(spark):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, one, 0), (1, two, 0), (2, one, 0), (3, two, 0), (1, one, 5)], "doc_id long, text string, id int")
    for kept in (nd.near_dedup(docs), nd.near_dedup(docs, shingle=5, similarity=0.8)):
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, one), (1, two)] and kept.columns == docs.columns
    assert len({r.id for r in nd.near_dedup(docs).collect() if r.text == one}) == 1


def test_odd_and_empty(odd, empty):
    rows = nd.near_dedup_rows(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 10)} == {1}
    assert {(r.fp, r.component_id) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 3)}
    kept = nd.near_dedup(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 11]
    assert nd.near_dedup_rows(empty).collect() == [] and nd.near_dedup(empty).collect() == []
