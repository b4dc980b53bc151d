import random
from collections import defaultdict

from quarry.llm import packing as pk


def test_tightest_compatible_bin():
    """Replays the placements, looking at every open bin for every item."""
    rng = random.Random(7)
    for _ in range(30):
        items = [(i, rng.choice("aaabcdefgh"), rng.randrange(60), rng.randrange(0, 101)) for i in range(200)]
        placed = {r[0]: r for r in pk.pack_group(items, 100)}
        bins: dict[int, list] = {}
        for doc_id, source, cluster, size in sorted(items, key=lambda r: (-r[3], r[2], r[0])):
            fits = [b for b, (residual, sources, clusters) in bins.items() if residual >= size and source not in sources and cluster not in clusters]
            bin_, offset = placed[doc_id][5:]
            if fits:
                assert bin_ in fits and bins[bin_][0] == min(bins[b][0] for b in fits)
            else:
                assert bin_ == len(bins)
                bins[bin_] = [100, set(), set()]
            assert offset == 100 - bins[bin_][0]
            bins[bin_][0] -= size
            bins[bin_][1].add(source)
            bins[bin_][2].add(cluster)


def check(rows, capacity):
    used, sources, clusters = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        used[r.bin_id].append((r.bin_offset, r.n_words))
        sources[r.bin_id].append(r.source)
        clusters[r.bin_id].append(r.cluster)
    for b, spans in used.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= capacity
        assert len(set(sources[b])) == len(sources[b]) and len(set(clusters[b])) == len(clusters[b])


def test_every_word_has_a_place(spark, sf, texts):
    rows = pk.op5_packing(spark, sf).collect()
    check(rows, pk.CAPACITY)
    words = defaultdict(int)
    for r in rows:
        words[r.doc_id] += r.n_words
    assert words == {i: len((t or "").encode().split()) for i, t in texts.items()}


def test_odd_hot_and_empty(odd, empty, spark):
    rows = pk.pack_rows(odd, 100).collect()
    check(rows, 100)
    assert sum(r.n_words for r in rows) == sum(len((r.text or "").encode().split()) for r in odd.collect())
    assert len([r for r in rows if r.doc_id == 1]) == 2
    assert pk.pack_rows(empty).collect() == []
    hot = spark.range(3000).selectExpr("id AS doc_id", "concat('same words here ', id % 2) AS text", "'one' AS source")
    check(pk.pack_rows(hot, 50, 500).collect(), 50)
