import re
from collections import Counter

import numpy as np

from quarry.llm import language as lang
from quarry.llm.common import documents, remainder_of


def test_filters_hold_all_and_correct_false_positives():
    rng = np.random.default_rng(5)
    sets = {f"l{i}": rng.integers(0, 2**63, 3000, np.int64).view(np.uint64) for i in range(10)}
    f = lang.Filters(sets, positions=2**14)
    assert f.slices.dtype == np.uint64
    for i, name in enumerate(f.langs):
        counts = f.counts(sets[name])
        assert abs(counts[i] - 3000) < 1e-6
    other = rng.integers(0, 2**63, 20_000, np.int64).view(np.uint64)
    assert (f.counts(other) < 600).all()  # of 20,000, though the filters claim a tenth of them
    few = lang.Filters({k: sets[k] for k in list(sets)[:3]})
    assert few.slices.dtype == np.uint8


def test_grams_are_those_of_brute_force():
    text = "  Ab, c1d  É! "
    clean = " ab c d é "
    a, b = lang.grams(text), lang.grams(clean)
    assert len(a) == len(clean) - 3 and (a == b).all()
    assert len(lang.grams("123 ,.")) == 0 and len(lang.grams(None)) == 0


def test_pieces_give_the_same_grams():
    text = "ab  12cd-ef" * 30 + " " * 50 + "é" + " " * 40
    whole = list(lang.gram_parts(text, 10**6))
    assert len(whole) == 1
    for piece in (1, 2, 3, 7, 64):
        assert (np.concatenate(list(lang.gram_parts(text, piece))) == whole[0]).all()
    assert len(np.concatenate(list(lang.gram_parts(" " * 20 + "x" + " " * 20, 7)))) == 1  # a letter is never lost
    assert list(lang.gram_parts(" 1" * 20, 7)) == []


def plain_grams(text):
    clean = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ")
    return [clean[i : i + 4] for i in range(max(1, len(clean) - 3))] if clean.strip() else []


def test_query_is_brute_force(spark, sf):
    rows = documents(spark, sf).collect()
    seen = {}
    for r in rows:  # SAMPLE lets every document in at this size
        if r.lang is not None and remainder_of(r.doc_id, 4) != 2:
            seen.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    rate = {k: {g: n / c.total() for g, n in c.items()} for k, c in seen.items()}
    most = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    own = {k: {g for g, x in r.items() if x >= lang.OWN * most[g]} for k, r in rate.items()}
    got, held = {r.doc_id: r for r in lang.op3_language(spark, sf).collect()}, 0
    assert len(got) == len(rows)
    for r in rows:
        grams = plain_grams(r.text)
        counts = {k: sum(g in own[k] for g in grams) for k in sorted(own)}
        first, second, *_ = sorted(counts.values(), reverse=True)
        if not grams:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
        # a filter claims a few different n-grams wrongly, each as often as it occurs
        off = max(sum(n for _, n in Counter(g for g in grams if g not in own[k]).most_common(4)) for k in own) if grams else 0
        if grams and first - second > 2 * off:
            assert got[r.doc_id].lang_pred == max(counts, key=counts.get)
            assert abs(got[r.doc_id].score - first / (first + second)) < 0.01 + off / (first + second)
            held += 1
    assert held > 0.5 * len(rows)


def test_rare_and_many_languages(spark):
    docs = [(i, f"{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)} q{i % 7}", f"l{i % 90}") for i in range(1800)] + [(5000, "zeldzame woorden", "rare")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert {"rare"} <= set(lang.fit(df).langs) and len(lang.fit(df).langs) == 91
    assert lang.fit(df).predict("zeldzame")[0] == "rare"


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: (r.lang, len(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lang.op3_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (remainder_of(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id][1] > 20]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)


def test_odd_and_empty(odd, empty):
    rows = {(r.doc_id, r.lang_pred, r.score) for r in lang.language_rows(odd).collect()}
    assert {p for i, p, _ in rows if i in (3, 4, 5)} == {"und"}
    assert {p for i, p, _ in rows if i == 6} == {"en"}
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert lang.language_rows(empty).collect() == []
    assert {r.lang_pred for r in lang.language_rows(odd.withColumn("lang", odd.lang.substr(9, 1)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
