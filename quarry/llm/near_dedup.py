"""SimHash near-duplicates through an index over byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, split_words, trimmed, written
from quarry.llm.components import components, labelled
from quarry.llm.exact_dedup import keep_rows

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BYTES = 8
#: Fingerprints of a list that are compared in one task.
CHUNK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: bit i is 1 if set in over half of the XXH64 hashes of its word shingles, repeats included."""
    words = split_words(text)
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(x, SEED) for x in parts], "<u8")
    # 4096 shingles at a time, so that a very long text needs no 64-fold copy of itself
    ones = sum(np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(hashes), 4096))
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"])


def key_positions(most_bits: int = MOST_BITS) -> list[tuple[int, ...]]:
    """The sets of byte positions whose bytes form the index's keys.

    The BYTES positions are cut in most_bits + 2 parts. Fingerprints that differ in most_bits bytes leave two parts
    whole, at least, so each pair within most_bits shares the key of some two parts.
    """
    parts = np.array_split(np.arange(BYTES), most_bits + 2)
    return [tuple(np.concatenate(two).tolist()) for two in combinations(parts, 2)]


def list_links(values: np.ndarray, most_bits: int = MOST_BITS, block: int = 256, other: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, counts): pairs within `most_bits` among the fingerprints (uint64) of one list of the index, or between it
    and `other`, enough to connect all that are connected, and the numbers of pairs tallied, retained and verified.

    Tallies the positional bytes that each pair shares. Fingerprints at most k bits apart differ in at most k bytes, so
    BYTES - k matches are the guaranteed minimum: pairs that don't reach it are dropped, the others verified by Hamming
    distance. Blocks of rows are compared with the list, in bounded memory; of the links found, those that join parts
    that were already connected are left out.
    """
    every = values if other is None else np.concatenate((values, other))
    parent = np.arange(len(every))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, counts = [], np.zeros(3, np.int64)
    for start in range(0, len(values), block):
        rows = values[start : start + block]
        for begin in range(start if other is None else len(values), len(every), 4096):
            apart = rows[:, None] ^ every[None, begin : begin + 4096]
            shared = (apart.view(np.uint8).reshape(*apart.shape, BYTES) == 0).sum(2, dtype=np.uint8)
            i, j = np.nonzero(shared >= BYTES - most_bits)
            later = i + start < j + begin
            i, j = i[later], j[later]
            true = np.bitwise_count(apart[i, j]) <= most_bits
            counts += int((np.arange(start, start + len(rows))[:, None] < np.arange(begin, begin + apart.shape[1])).sum()), len(i), int(true.sum())
            for x, y in zip((i[true] + start).tolist(), (j[true] + begin).tolist()):
                if (p := root(x)) != (q := root(y)):
                    parent[p] = q
                    out.append((x, y))
    return out, counts


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = [], []
        for held, i, j in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
            fp, chunk = (held.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            first = np.sort(fp[chunk == i]).view(np.uint64)
            second = np.sort(fp[chunk == j]).view(np.uint64) if i != j else None
            every = first if second is None else np.concatenate((first, second))
            links, _ = list_links(first, other=second)
            a += [every[x] for x, _ in links]
            c += [every[y] for _, y in links]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, c)], names=["a", "b"])


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints of `prints` (fp), connecting all that are connected at MOST_BITS or fewer.

    Each fingerprint stands in one list for each of `key_positions`. A list of more than CHUNK is dealt to chunks by a
    hash, and each pair of chunks is compared by itself, so no list is one task's, however long.
    """
    masks = [int.from_bytes(bytes(255 * (p in held) for p in range(BYTES)), "little", signed=True) for held in key_positions()]
    keys = F.array(*(F.struct(F.lit(i).cast("byte").alias("set"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)))
    # spread first: what was written is few and small files
    postings = prints.select("fp").repartition("fp").select("fp", F.explode(keys).alias("key")).select("fp", "key.*")
    long = postings.groupBy("set", "bytes").count().where(F.col("count") > CHUNK).select("set", "bytes", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks"))
    long = written(long, "long_lists")
    if long.head():
        postings = postings.join(long, ["set", "bytes"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    else:
        postings = postings.withColumn("chunks", F.lit(1))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk")
    dealt = postings.select("set", "bytes", "fp", chunk, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    dealt = dealt.groupBy("set", "bytes", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    dealt = dealt.agg(F.collect_list(F.struct("fp", "chunk")).alias("held")).where(F.size("held") > 1)
    return dealt.select("held", "i", "j").mapInArrow(_links, "a long, b long")


def near_dedup_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, fp (bigint), text_hash, label, component_id.

    Fingerprints link at MOST_BITS or fewer differing bits; component_id is the smallest doc_id reachable over links,
    label the smallest fingerprint. Null and empty texts have fingerprint zero, which is linked like any other. Rows
    with equal fingerprints are one node, so a group of copies adds nothing to the index; repeated rows stay. Null ids
    are members but never give a component its id (null if it has no other). An empty table gives no rows. A very long
    text takes memory in proportion: its words, and 8 bytes for each shingle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = written(rows.mapInArrow(lambda it: trimmed(_fingerprints(it)), "doc_id long, fp long, text_hash long"), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(written(link_fingerprints(nodes), "links"))
    return labelled(rows, nodes, labels)


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest doc_id, then the smallest hash of its text. All columns stay.

    With `similarity`, groups are linked by the Jaccard similarity of sets of `shingle` words, found through fingerprints of
    drawn shingles within MOST_BITS and checked (`similar_rows`), else by fingerprints of all SHINGLE words within
    MOST_BITS (`near_dedup_rows`). Null ids come last; of rows that repeat the id
    and the text one stays (`keep_rows`). Null and empty texts are one group. An empty table stays empty.
    """
    from quarry.llm.similar_sets import similar_rows  # which goes through this module's index

    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints have a fixed shingle size")
    rows = near_dedup_rows(docs) if similarity is None else similar_rows(docs, shingle, similarity)
    rows = written(rows.select("label", F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash").alias("key")), "groups")
    stays = rows.groupBy("label").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("stays"))
    fate = rows.join(stays.hint("merge"), "key", "left")
    return keep_rows(docs, fate.select(F.expr("if(key.no_id, null, key.id)").alias("doc_id"), "key.text_hash", F.coalesce("stays", F.lit(False)).alias("kept")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup_rows(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
