import hashlib
import random
from collections import defaultdict

from quarry.llm import exact_dedup as ed


def test_index_against_a_dict():
    rng = random.Random(12)
    index, plain = ed.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(k) == (plain.pop(k, None) is not None)
        else:
            index.put(k, step)
            plain[k] = step
        assert len(index) == len(plain)
    assert dict(index.items()) == plain and all((k in index) == (k in plain) for k in keys)


def test_equal_tags_are_told_apart_and_overflow_resizes():
    index = ed.CuckooIndex(1)
    keys = [bytes(8) + i.to_bytes(24, "big") for i in range(3)] + [b"\1" + bytes(7) + i.to_bytes(24, "big") for i in range(3)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert [index.get(k) for k in keys] == list(range(6)) and index.get(bytes(32)[:-1] + b"\xff") is None


def plain(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), i))
    return groups


def test_against_brute_force(spark, sf, texts):
    rows = {r.doc_id: r for r in ed.op8_exact_dedup(spark, sf).collect()}
    assert len(rows) == len(texts)
    for norm, members in plain(texts.items()).items():
        keep = min(members)[1]
        for _, i in members:
            assert rows[i][1:] == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())


def test_odd_and_empty(odd, empty):
    rows = ed.dedup_rows(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r.kept for r in rows) == len(plain((r.doc_id, r.text) for r in odd.collect()))
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (1, 2)} == {(2, 3)}
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id in (3, 4, 5)} == {(5, 4)}
    kept = ed.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert ed.dedup_rows(empty).collect() == [] and ed.exact_dedup(empty).collect() == []


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(7, "same text", i) for i in range(5)] + [(8, "other", 0)], "doc_id long, text string, __id int")
    assert sorted((r.doc_id, r.text) for r in ed.exact_dedup(docs).collect()) == [(7, "same text"), (8, "other")]
    assert sum(r.kept for r in ed.dedup_rows(docs).collect()) == 2
