import hashlib
from collections import Counter

import numpy as np

from quarry.llm import fingerprint as fp


M = 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 32)) * int(fp._B)) & M
    return x ^ (x >> 29)


def plain_level(symbols):
    """One level's phrase names, symbol by symbol: runs, four tosses, cuts at local maxima, names of phrases."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else mixed((s + n * int(fp._C)) & M) for s, n in runs]
    label = symbols
    for _ in range(4):
        tossed = [label[0] & 1]
        for left, x in zip(label, label[1:]):
            k = ((left ^ x) & -(left ^ x)).bit_length() - 1
            tossed.append(2 * k + (x >> k & 1))
        label = tossed
    cuts = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]] + [len(label)]
    names = []
    for a, b in zip(cuts, cuts[1:]):
        name = b - a
        for s in symbols[a:b]:
            name = ((name ^ s) * int(fp._A) + int(fp._C)) & M
            name ^= name >> 32
        names.append(mixed(name))
    return names


def plain_fingerprint(text):
    symbols, level, least = [ord(c) for c in text], 0, {}
    if not symbols:
        return "0" * (16 + 2 * fp.SLOTS)

    def sample(names, level):
        for x in names:
            h = mixed((x + level * int(fp._C)) & M)
            least[h >> 57] = min(least.get(h >> 57, M), h & (2**57 - 1))

    while True:
        if level in fp.LEVELS:
            sample(symbols, level)
        if len(symbols) == 1:
            for above in fp.LEVELS:
                if above > level:
                    sample(symbols, above)
            break
        symbols, level = plain_level(symbols), level + 1
    root = mixed((symbols[0] + len(text) * int(fp._A)) & M)
    return f"{root:016x}" + "".join(f"{least[s] % 255 + 1:02x}" if s in least else "00" for s in range(fp.SLOTS))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    slots = [(a[i : i + 2], b[i : i + 2]) for i in range(16, len(a), 2)]
    used = [(x, y) for x, y in slots if (x, y) != ("00", "00")]
    return min(1.0, max(0.0, (sum(x == y for x, y in used) / len(used) - 1 / 255) / (1 - 1 / 255))) if used else 0.0


def test_hot_ids_are_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 20)
    monkeypatch.setattr(fp, "LARGER", 1)
    docs = [(None, f"no id {i}") for i in range(100)] + [(7, f"seven {i}") for i in range(100)] + [(i, f"text {i}") for i in range(8, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = fp.keyed(df)
    bounds, firsts = fp.range_bounds(rows)
    of = rows.withColumn("r", fp.range_of(bounds)).collect()
    assert max(Counter(r.r for r in of).values()) < 80
    order = sorted(of, key=lambda r: (r.doc_id, r.h))
    assert [r.r for r in order] == sorted(r.r for r in of)  # ranges are in the rows' order
    got = {(r.doc_id, r.fingerprint): r.edited_sha256 for r in fp.fingerprint_rows(df).collect()}
    for r, after in zip(order, order[1:] + order[:1]):
        want = hashlib.sha256(fp.edited(r.text, after.text).encode()).hexdigest()
        assert got[None if r.is_null else r.doc_id, plain_fingerprint(r.text)] == want


def test_against_brute_force(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 30)
    rows = sorted(fp.op1_fingerprint(spark, sf).collect())
    ids = sorted(texts)
    own = [texts[i] or "" for i in ids]
    edits = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(own, own[1:] + own[:1])]
    assert [r.doc_id for r in rows] == ids
    assert [r.n_chars for r in rows] == list(map(len, own))
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in edits]
    prints, edited = list(map(plain_fingerprint, own)), list(map(plain_fingerprint, edits))
    assert [r.fingerprint for r in rows] == prints and [r.edited_fingerprint for r in rows] == edited
    for r, a, b, c in zip(rows, prints, edited, prints[1:] + prints[:1]):
        assert abs(r.near_edited - plain_likeness(a, b)) < 1e-12 and abs(r.near_next - plain_likeness(a, c)) < 1e-12
    assert np.mean([r.near_edited for r in rows]) > 0.45
    assert np.mean([r.near_next for r in rows if texts[r.doc_id] != texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]]) < 0.1


def test_substrings_share_interior_phrases():
    rng = np.random.default_rng(1)
    middle = rng.integers(97, 123, 4000)
    found = []
    for before in (0, 1, 7, 100):
        x = np.concatenate((rng.integers(97, 123, before), middle, rng.integers(97, 123, 50))).astype(np.uint32)
        names, doc = fp.parse(x, np.zeros(len(x), np.int32))
        names, _ = fp.parse(names, doc)
        found.append(names)
    for other in found[1:]:
        assert len(set(found[0]) & set(other)) > 0.9 * len(set(found[0]))


def test_phrase_lengths_and_runs():
    x = np.random.default_rng(2).integers(0, 4, 5000).astype(np.uint32)
    label = fp._tossed(x[np.append(True, x[1:] != x[:-1])], np.append(True, np.zeros((x[1:] != x[:-1]).sum(), bool)))
    assert label.max() < 6 and (label[1:] != label[:-1]).all()
    names, doc = fp.parse(np.full(1000, 7, np.uint32), np.zeros(1000, np.int32))
    assert len(names) == 1
    a, b = fp.fingerprints(["aaaa" * 100, "aaaa" * 101])
    assert a != b


def test_likeness_bounds():
    a, b, none = fp.fingerprints(["one text that is long enough to have some phrases in it", "a wholly different string 12345 67890", ""])
    assert fp.likeness(a, a) == fp.likeness(none, none) == 1.0
    assert 0 <= fp.likeness(a, b) < 0.3 and fp.likeness(a, none) == 0.0
    assert set(none) == {"0"}


def test_odd_and_empty(odd, empty):
    rows = fp.fingerprint_rows(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.doc_id is None for r in rows) == 2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert fp.fingerprint_rows(empty).collect() == []
    alone = odd.where("doc_id = 7")
    (one,) = fp.fingerprint_rows(alone).collect()
    assert one.near_next == 1.0
