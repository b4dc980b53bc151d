import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from quarry.llm import fingerprint as fp
from quarry.llm import token_files as tf
from quarry.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, tokenizer=Tokenizer.from_file(PATH)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    texts = ["", "  a\tb c  　d", "it's DON'T we'll ’s 12½² ́x é İstanbul ΣΣ ok", "<|endoftext|> a<|startoftext|>b <|end", "!!! 😀😀 a_b-c__ \x1c\x1d x y",
             "ﬁ Å Å ẞ ß", "a'sb 'S ''ll x'T", "क्ष नमस्ते 中文字 123 ١٢", "\x00\x01 a\x85b", "word " * 3000]
    assert [g.tolist() for g in tf.Encoder(PATH).encode(pa.array(texts))] == [ids_of(t) for t in texts]
    assert list(tf.Encoder(PATH).encode(pa.array([], pa.string()))) == []


def test_every_plain_character_is_encoded_as_the_library_does(monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 500)
    monkeypatch.setattr(tf, "TOGETHER", 3000)
    kinds = "a", "'", "1", ".", "S", "é"
    texts = [f"{chr(c)} x{chr(c)}y{chr(c)}{chr(c)} {b}{chr(c)}{b} '{chr(c)}{b}" for c in range(0x300) for b in kinds]
    code = tf.Encoder(PATH)
    assert code.by_pieces
    assert [g.tolist() for g in code.encode(pa.array(texts))] == [ids_of(t) for t in texts]
    plain = [c for c in range(0x300) if not pc.match_substring_regex(pa.array([chr(c)]), tf._UNSURE)[0].as_py()]
    assert len(plain) > 600 and ord("é") in plain


def test_documents_are_encoded_as_the_library_does(spark):
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.01").select("text").collect()]
    assert [g.tolist() for g in tf.Encoder(PATH).encode(pa.array(texts))] == [ids_of(t) for t in texts]


def test_other_tokenizers_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts, other = ["It's  a test, ok?", "é 12"], Tokenizer.from_file(path)
    code = tf.Encoder(path)
    assert not code.by_pieces
    assert [g.tolist() for g in code.encode(pa.array(texts))] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_folder_is_the_one_that_spark_means(spark, tmp_path, monkeypatch):
    conf = spark._jsc.hadoopConfiguration()
    assert tf.store_folder(spark, str(tmp_path / "a b")) == f"file://{tmp_path}/a b"
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://own/")
        conf.set("fs.viewfs.mounttable.own.link./held", f"file://{tmp_path}")
        assert tf.store_folder(spark, "/held/x") == f"file://{tmp_path}/x"  # not the machine's own /held/x
    finally:
        conf.set("fs.defaultFS", before)
    monkeypatch.setattr(tf, "_SCHEMES", {})
    with pytest.raises(ValueError, match="token files"):
        tf.store_folder(spark, str(tmp_path))


def test_round_trip(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 30)
    rows = sorted(tf.op4_token_files(spark, sf).collect())
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = ids_of(texts[i]) + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_sequences_are_equal_long_views(tmp_path):
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 49_000, n).astype("<u2") for n in (1, 0, 5000, 300_000, 7)]
    path = str(tmp_path / "x.arrow")
    out = tf.SequenceWriter(path, np.dtype("<u2"))
    for d in docs:
        out.add(d.tobytes())
    out.close()
    held, whole = tf.SequenceFile(path), np.concatenate(docs)
    n = -(-len(whole) // tf.LENGTH)
    for i in (0, 1, 63, 64, n - 1):
        part = whole[i * tf.LENGTH : (i + 1) * tf.LENGTH]
        assert len(held.sequence(i)) == tf.LENGTH
        assert (held.sequence(i)[: len(part)] == part).all() and held.mask(i).sum() == len(part)
    assert (held.ids(5001, 300_000) == docs[3]).all() and len(held.ids(1, 0)) == 0
    # a view of the mapped file, not a copy
    before = pa.total_allocated_bytes()
    views = [held.sequence(i) for i in range(n)]
    assert not any(v.flags.owndata for v in views) and pa.total_allocated_bytes() - before < 10_000


def test_odd_and_empty(odd, empty, tmp_path):
    rows = tf.read_token_files(tf.write_token_files(odd, str(tmp_path / "a"), PATH)).collect()
    assert len(rows) == odd.count()
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect())
    got = sorted(rows, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert [r.n_tokens for r in got] == [len(ids_of(t)) + 1 for *_, t in want]
    assert tf.read_token_files(tf.write_token_files(empty, str(tmp_path / "b"), PATH)).collect() == []
