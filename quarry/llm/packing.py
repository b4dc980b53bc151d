"""Conflict-constrained best-fit packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, documents, trimmed, written

#: Words that a bin holds, and documents that are packed together.
CAPACITY = 1024
GROUP = 1024


class Bins:
    """Open bins by residual capacity. Each carries a bitmap of the sources and duplicate clusters it holds.

    `place` looks at the residuals from the item's size upwards, smallest first, and within one residual at the bins
    in order of opening, until a bin without the item's bits is found: the tightest compatible one.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_residual: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # bin: bitmap
        self.filled = 0  # bit r: some bin has residual r
        self.count = 0

    def open(self) -> int:
        self.count += 1
        return self.count - 1

    def _put(self, bin_: int, residual: int, bitmap: int) -> None:
        self.by_residual[residual][bin_] = bitmap
        self.filled |= 1 << residual

    def place(self, size: int, bits: int) -> tuple[int, int]:
        """(bin, offset in the bin) for an item of `size` with the bitmap `bits`."""
        later = self.filled >> size << size
        while later:
            residual = (later & -later).bit_length() - 1
            here = self.by_residual[residual]
            for bin_, bitmap in here.items():
                if not bitmap & bits:
                    del here[bin_]
                    if not here:
                        self.filled ^= 1 << residual
                    self._put(bin_, residual - size, bitmap | bits)
                    return bin_, self.capacity - residual
            later &= later - 1
        bin_ = self.open()
        self._put(bin_, self.capacity - size, bits)
        return bin_, 0


def pack_group(items: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, cluster, size) items to (doc_id, source, cluster, piece, size, bin, offset) rows.

    Items longer than a bin fill whole bins of their own; what is left of them is packed with the others, largest
    first, ties by cluster, id (null last) and source. No bin gets two items of one source or one cluster.
    """
    bins, out, rest = Bins(capacity), [], []
    bits: dict[tuple, int] = {}
    for doc_id, source, cluster, size in items:
        whole = size // capacity if size > capacity else 0
        out += [(doc_id, source, cluster, k, capacity, bins.open(), 0) for k in range(whole)]
        if size - whole * capacity or not whole:
            rest.append((doc_id, source, cluster, whole, size - whole * capacity))
    for doc_id, source, cluster, piece, size in sorted(rest, key=lambda r: (-r[4], r[2], r[0] is None, r[0] or 0, r[1] or "")):
        mine = bits.setdefault(("source", source), 1 << len(bits))
        mine |= bits.setdefault(("cluster", cluster), 1 << len(bits))
        out.append((doc_id, source, cluster, piece, size, *bins.place(size, mine)))
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, cluster = [], []
        for text in b.column(2).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            size.append(len(raw.split()))
            cluster.append(xxhash.xxh3_64_intdigest(raw.translate(None, SPACES)) - 2**63)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(cluster, pa.int64())], names=["doc_id", "source", "size", "cluster"])


def pack_rows(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text, source): doc_id, source, cluster, piece, n_words,
    bin_id, bin_offset.

    A bin holds at most `capacity` words and no two documents of one source or one duplicate cluster (texts equal
    without white space). A document longer than a bin is cut into full bins and a rest, so every word has one place.
    Null and empty texts are one piece without words; null sources are one source. An empty table gives no rows.

    Documents are dealt by a hash of their id and text to groups of about `group` documents, which are packed
    independently: a hot source or a large cluster is spread over all groups, no task holds more than a group at a
    time, and the bins that groups leave partly open cost about one in a few hundred.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = written(rows.mapInArrow(lambda it: trimmed(_sizes(it)), "doc_id long, source string, size long, cluster long"), "pieces")
    groups = max(1, -(-rows.count() // group))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        sources = [x if isinstance(x, str) else None for x in pdf["source"]]
        out = pack_group(list(zip(ids, sources, pdf["cluster"].tolist(), pdf["size"].tolist())), capacity)
        out = pd.DataFrame(out, columns=["doc_id", "source", "cluster", "piece", "n_words", "bin_id", "bin_offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["bin_id"] += g << 32
        return out

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(pack, "doc_id long, source string, cluster long, piece long, n_words long, bin_id long, bin_offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_rows(documents(spark, sf_dir))
