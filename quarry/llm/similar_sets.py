"""Links between documents whose sets of word shingles have a given Jaccard similarity: SimHash fingerprints of drawn shingles, the
index over byte positions, and an exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import split_words, trimmed, written
from quarry.llm.components import components, labelled
from quarry.llm.near_dedup import link_fingerprints

#: Words of a shingle and the least similarity of two near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a set and shingles drawn for each: of two sets of similarity s no draw is the same with probability
#: (1 - s ** DRAWN) ** PRINTS, 2.5e-6 at 0.8. An odd number, so that over half of the hashes is as often one as zero.
PRINTS, DRAWN = 18, 3
#: Places of a sketch; members of a list's chunk; sets that a batch carries from Python.
BITS, CHUNK, BATCH = 512, 2048, 1000
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, PRINTS * DRAWN, np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSES = np.array([pow(f, -1, 2**64) for f in _FACTORS.tolist()], np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 hashes (uint64) of a text's different word shingles; a shorter text is one shingle, one without words none."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in parts], np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """A name (int64) for a set: equal sets have equal names."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """PRINTS SimHash fingerprints (int64) of a set, each of DRAWN of its shingles: those that come first by a hash of the fingerprint's own.

    Bit i is 1 if set in over half of the drawn shingles' XXH64, as in `near_dedup.fingerprint`. Similar sets draw the
    same shingle with a probability of their similarity, and fingerprints of the same shingles are the same; a
    fingerprint of all shingles would differ in 15 % of its bits at 0.8, which no byte of it survives for sure.
    """
    least = np.full(PRINTS * DRAWN, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 256):  # in bounded memory, however long the text
        # the product's low bits depend on few bits of the hash, its high ones on all
        np.minimum(least, (hashes[i : i + 256, None] * _FACTORS).min(0), out=least)
    a, b, c = (least * _INVERSES).reshape(PRINTS, DRAWN).T
    return ((a & b) | (a & c) | (b & c)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `least`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of BITS places, packed in int64, whether an odd number of the set's hashes fall there.

    Sketches of two sets differ in no more places than there are hashes in one set alone.
    """
    return np.packbits(np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).view(np.int64)


def cross_pairs(held: pa.StructArray, least: float, block: int = 256) -> pa.RecordBatch:
    """Pairs (a < b) of members (fp, label, n, sketch) with different labels, but those whose sizes or sketches rule the similarity out."""
    fp, label, n = (held.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    order = np.argsort(fp, kind="stable")
    fp, label, n = fp[order], label[order], n[order].astype(np.float64)
    marks = held.field(3).flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order]
    a, b = [], []
    for start in range(0, len(fp), block):
        rows = slice(start, start + block)
        small, large = np.minimum(n[rows, None], n), np.maximum(n[rows, None], n)
        apart = sum(np.bitwise_count(marks[rows, None, k] ^ marks[None, :, k]).astype(np.int32) for k in range(marks.shape[1]))
        # similar sets have at most this share of their sizes' sum in one of them alone
        may = (apart <= (small + large) * (1 - least) / (1 + least) + 1e-6) & (small >= large * least - 1e-6)
        i, j = np.nonzero(may & (label[rows, None] != label) & (fp[rows, None] < fp))
        a.append(fp[i + start])
        b.append(fp[j])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], names=["a", "b"])


def _may(least: float) -> Column:
    """Whether the sizes and sketches of two sets (na, nb, sa, sb) allow that similarity, as in `cross_pairs`."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (apart <= (small + large) * ((1 - least) / (1 + least)) + 1e-6) & (small >= large * least - 1e-6)


def _verified(own: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Those of `pairs` (a, b: names) whose sets are similar, checked on the whole sets.

    The texts are met by the hashes of those that the pairs name, one for each set; only if these are too many to be
    sent to every task are the texts moved.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = written(named.join(nodes.select("fp", "text_hash"), "fp").select(F.col("text_hash").alias("h")), "wanted")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # bounded: forgotten now and then, as Spark drops the others
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                sets = [shingle_set(t, shingle) for t in b.column(0).slice(start, BATCH).to_pylist()]
                names = [name_of(s) for s in sets]
                new = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in new], pa.int64()), pa.array([sets[i].view(np.int64) for i in new], pa.list_(pa.int64()))], names=["name", "hashes"])
                if len(seen) > 1_000_000:
                    seen.clear()

    met = own.select("text", "text_hash").join(wanted, F.col("text_hash") == F.col("h"), "left_semi").select("text")
    sets = written(met.mapInArrow(lambda it: trimmed(sets_of(it)), "name long, hashes array<long>").dropDuplicates(["name"]), "hashes")
    one = lambda k: sets.select(F.col("name").alias(k), F.col("hashes").alias(f"{k}s"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c) for c in (2, 3))
            true = [similar(p.values.to_numpy(zero_copy_only=False).view(np.uint64), q.values.to_numpy(zero_copy_only=False).view(np.uint64), least) for p, q in zip(x, y)]
            yield b.select(["a", "b"]).filter(pa.array(true, pa.bool_()))

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "as", "bs").mapInArrow(lambda it: trimmed(check(it)), "a long, b long")


def similar_rows(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, fp (name of its shingle set), text_hash, label, component_id.

    Sets link at a Jaccard similarity of `least` or more; component_id is the smallest doc_id reachable over links, as
    in `near_dedup_rows`. Texts without words are one set, linked to no other. Null ids never give a component its id.

    Each set has PRINTS SimHash fingerprints, which go through the operator's index (`near_dedup.link_fingerprints`: lists
    by byte positions, count filter, Hamming distance). Sets with linked fingerprints are candidates, a list for each
    group of linked fingerprints, and each link is checked on the whole sets. First each posting is tried with
    two members of its list, so a large group of copies costs pairs in proportion to its size; then, in lists whose
    members are still in different parts, all pairs from different parts. Of both only pairs are checked that sizes and
    sketches allow, which rules out no similar pair. No list is cut. Rows that repeat stay; an empty table gives no
    rows. A very long text takes memory in proportion: its words, and 8 bytes for each shingle.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, BATCH):
                part = b.slice(start, BATCH)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                arrays = [
                    part.column(0), pa.array([name_of(s) for s in sets], pa.int64()), part.column(2), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([fingerprints(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "text_hash", "n", "sketch", "prints"])

    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = written(own.mapInArrow(lambda it: trimmed(named(it)), "doc_id long, fp long, text_hash long, n int, sketch array<long>, prints array<long>"), "sets")
    # equal sets have equal sketches and fingerprints, so any of them will do
    first = (F.first(c).alias(c) for c in ("n", "sketch", "prints"))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), *first), "nodes")
    every = nodes.select("fp", F.explode(F.array_distinct("prints")).alias("key"))
    alike = components(written(link_fingerprints(every.select(F.col("key").alias("fp")).distinct()), "print_links"))
    if alike.head():
        every = every.join(alike, F.col("key") == F.col("node"), "left").select("fp", F.coalesce("label", "key").alias("key")).distinct()
    # a list for each group of linked fingerprints; it has an order of its own, so that a large group meets other members in each
    every = every.withColumn("turned", F.col("fp").bitwiseXOR(F.xxhash64("key")))
    ends = every.groupBy("key").agg(F.min("turned").alias("lo"), F.max("turned").alias("hi")).where("lo <> hi")
    ends = written(ends.select("key", *(F.col(c).bitwiseXOR(F.xxhash64("key")).alias(c) for c in ("lo", "hi"))), "ends")
    postings = written(every.join(ends, "key").select("key", "fp", "lo", "hi"), "postings")

    def allowed(pairs: DataFrame) -> DataFrame:
        for k in "ab":
            pairs = pairs.join(nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")), k)
        return pairs.where(_may(least)).select("a", "b")

    tried = postings.select(F.explode(F.array(*(F.struct("fp", F.col(c).alias("end")) for c in ("lo", "hi")))).alias("p")).select("p.*").where("fp <> end")
    tried = written(allowed(tried.select(F.least("fp", "end").alias("a"), F.greatest("fp", "end").alias("b")).distinct()), "tried")
    links = written(_verified(own, nodes, tried, shingle, least), "links")
    labels = components(links)
    placed = written(postings.join(labels, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("label", "fp").alias("label")), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("l < m")
    placed = placed.join(mixed.select("key", "chunks"), "key").join(nodes.select("fp", "n", "sketch"), "fp")
    # a long list is compared by pairs of chunks, each of which is a group of its own
    own_chunk = placed.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = own_chunk.groupBy("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    dealt = dealt.agg(F.collect_list(F.struct("fp", "label", "n", "sketch")).alias("held")).where(F.size("held") > 1)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held in b.column(0):
                yield cross_pairs(held.values, least)

    pairs = dealt.select("held").mapInArrow(crossed, "a long, b long").distinct()
    pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    if pairs.head():
        labels = components(links.union(written(_verified(own, nodes, pairs, shingle, least), "more_links")))
    return labelled(rows, nodes, labels)
