"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents

#: Levels whose phrases a fingerprint samples, slots of the sample, and rounds of coin tossing in a level.
LEVELS = (2, 3)
SLOTS = 128
TOSSES = 4
#: Documents of one range of ids, about: as few as this on small inputs, up to so many times this on large ones, and the
#: most ranges, as their bounds pass through the driver. A range is sorted, spilling if need be, and read in one task.
RANGE_ROWS, LARGER, MOST_RANGES = 4000, 12, 20_000
#: Characters that are parsed together, about; keeps the arrays in the processor's cache.
CHUNK = 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name (uint64) for each phrase symbols[starts[i]:starts[i + 1]], the same for equal phrases."""
    lengths = np.diff(np.append(starts, len(symbols)))
    name = lengths.astype(np.uint64)
    live = np.arange(len(starts))
    for place in range(int(lengths.max())):  # phrases are short; fewer and fewer have a symbol at this place
        if place:
            live = live[lengths[live] > place]
        name[live] = (name[live] ^ symbols[starts[live] + place].astype(np.uint64)) * _A + _C
        name[live] ^= name[live] >> np.uint64(32)
    return _mix(name)


def _first_of(doc: np.ndarray) -> np.ndarray:
    """Whether a symbol is its document's first."""
    first = np.empty(len(doc), bool)
    first[:1] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    return first


def _tossed(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, different for neighbours, fixed by a symbol and its TOSSES predecessors.

    A toss takes each symbol to 2k + bit k, k being the lowest bit in which it differs from its left neighbour: 64-bit
    symbols become labels below 128, then 14, 8 and 6. A document's first symbol is tossed against its complement.
    """
    label = symbols
    for _ in range(TOSSES):
        apart = np.empty_like(label)
        apart[1:] = label[1:] ^ label[:-1]
        apart[first] = 1
        k = np.bitwise_count(~apart & (apart - label.dtype.type(1)))
        bit = ((label >> k) & label.dtype.type(1)).astype(np.uint8)
        label = (k << np.uint8(1)) | bit
    return label


def parse(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, document of each) of the phrases that the symbols of the documents make.

    Runs of one symbol become one phrase each; then a phrase begins at each local maximum of the tossed labels, so
    phrases have 2 to 11 symbols and their boundaries depend on a few neighbours only: equal substrings are cut
    alike inside, at whatever offset they stand.
    """
    first = _first_of(doc)
    begins = first.copy()
    begins[1:] |= symbols[1:] != symbols[:-1]
    starts = np.flatnonzero(begins)
    if len(starts) < len(symbols):
        lengths = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
        symbols = np.where(lengths > np.uint64(1), _mix(symbols[starts].astype(np.uint64) + lengths * _C), symbols[starts].astype(np.uint64))
        doc, first = doc[starts], first[starts]
    label = _tossed(symbols, first)
    last = np.append(first[1:], True)
    peak = np.empty(len(label), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[:1] = peak[-1:] = False
    peak[last] = False
    starts = np.flatnonzero(peak | first)
    return _names(symbols, starts), doc[starts]


def fingerprints(texts: list[str]) -> list[str]:
    """For each text the name of the whole text, 16 hex digits, and a sample of its phrases, 2 hex digits a slot.

    The levels LEVELS give the set of phrases; one permutation hashing keeps for each slot 8 bits of the smallest hash
    (00: the slot is empty). The whole text is named by parsing on until one phrase is left. A text without characters
    has only zeros.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(c) for c in codes], np.int64)
    symbols = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n)
    root = np.zeros(len(texts), np.uint64)
    kept = np.full(len(texts) * SLOTS, np.iinfo(np.uint64).max, np.uint64)

    def sample(names: np.ndarray, of: np.ndarray, level: int) -> None:
        h = _mix(names.astype(np.uint64) + np.uint64(level * int(_C) % 2**64))
        np.minimum.at(kept, of.astype(np.int64) * SLOTS + (h >> np.uint64(57)).astype(np.int64), h & np.uint64(2**57 - 1))

    level = 0
    while len(symbols):
        if level in LEVELS:
            sample(symbols, doc, level)
        first = _first_of(doc)
        alone = first & np.append(first[1:], True)
        if alone.any():
            root[doc[alone]] = symbols[alone]
            if level < max(LEVELS):  # a short text's one phrase stands for the levels that it doesn't reach
                for above in LEVELS:
                    if above > level:
                        sample(symbols[alone], doc[alone], above)
            symbols, doc = symbols[~alone], doc[~alone]
        if len(symbols):
            symbols, doc = parse(symbols, doc)
        level += 1
    small = np.where(kept == np.iinfo(np.uint64).max, np.uint64(0), kept % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(len(texts), SLOTS)
    root = np.where(n > 0, _mix(root + n.astype(np.uint64) * _A), np.uint64(0))
    return [f"{r:016x}{s.tobytes().hex()}" for r, s in zip(root.tolist(), small)]


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness of two fingerprints' phrase sets, 0 to 1; equal fingerprints have 1.

    Slots that agree among those that either fills, less the 1 in 255 that agree by chance. An empty text is like
    another empty one and unlike all others.
    """
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), np.uint8) for s in (a, b))
    used = (x > 0) | (y > 0)
    if not (total := int(used.sum())):
        return 0.0
    agreed = int((used & (x == y)).sum()) / total
    return min(1.0, max(0.0, (agreed - 1 / 255) / (1 - 1 / 255)))


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many of the following text's first (or all it has)."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, is_null, text, h) of `docs`: null ids as the lowest number, null texts as empty, h a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("is_null"), text.alias("text"), F.xxhash64(text).alias("h"))


def range_bounds(rows: DataFrame) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(bounds, [(range, id, h of its first row), ...]) over `keyed` rows, ranges in order.

    The bounds are quantiles of the ids; an id that many rows have, or null, stands there as often as it fills ranges.
    """
    n = rows.count()
    per = min(max(RANGE_ROWS, n // (8 * rows.sparkSession.sparkContext.defaultParallelism)), LARGER * RANGE_ROWS)
    ranges = min(-(-n // per), MOST_RANGES)
    bounds = np.array(sorted(int(x) for x in rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)) if ranges > 1 else [], np.int64)
    firsts = rows.groupBy(range_of(bounds).alias("r")).agg(F.min(F.struct("doc_id", "h")).alias("first"))
    return bounds, sorted((r["r"], *r["first"]) for r in firsts.collect())


def range_of(bounds: np.ndarray):
    """The range of a `keyed` row: the number of bounds up to its id. Rows of an id that stands k times among the bounds
    are spread evenly over k ranges by the hash of their text, so they are in order of (doc_id, h)."""

    @F.pandas_udf("int")
    def find(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
        times = high - low
        part = ((h.to_numpy(np.int64) >> 32) + 2**31) * times >> 32
        return pd.Series(np.where(times > 1, low + 1 + part, high).astype("int32"))

    return find("doc_id", "h") if len(bounds) else F.lit(0)


def _range_before(firsts: list[tuple[int, int, int]]):
    """For the first row of a range, as (doc_id, h), the range before it (before the first one: the last); null for others."""
    before = {(i, h): firsts[k - 1][0] for k, (_, i, h) in enumerate(firsts)}
    ids = np.unique(np.array([i for _, i, _ in firsts], np.int64))

    @F.pandas_udf("int")
    def find(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        out = np.full(len(doc_id), -1, np.int32)
        of = doc_id.to_numpy(np.int64)
        for k in np.flatnonzero(np.isin(of, ids)).tolist():
            out[k] = before.get((int(of[k]), int(h.iloc[k])), -1)
        return pd.Series(out)

    found = find("doc_id", "h")
    return F.when(found >= 0, found)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the documents of sorted ranges; rows (r, ahead, doc_id, is_null, text), `ahead` for a later range's first."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [r[1] for r in rows] + [following]
        edits = [edited(t, u) for t, u in zip(texts, texts[1:])]
        prints = fingerprints(texts + edits)
        own, other = prints[: len(texts)], prints[len(texts) :]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]), pa.array(own[:-1]), pa.array(other),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    closed = None
    for b in batches:
        for r, ahead, doc_id, is_null, text in zip(*(b.column(c).to_pylist() for c in range(5))):
            text = text or ""
            if ahead:  # the text that follows this range's last; a repeated id may bring several, the first counts
                if held:
                    yield done(held, text)
                    held, size = [], 0
                closed = r
                continue
            if closed == r:
                raise RuntimeError("a range's rows come before the text that follows it")
            if held and size > CHUNK:
                yield done(held, text)
                held, size = [], 0
            held.append((None if is_null else doc_id, text))
            size += len(text)
    if held:
        raise RuntimeError("each range ends with the text that follows it")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is the next in order of (doc_id, hash of the text), null ids first; after the last comes the first,
    so a single document is followed by itself. Null texts count as empty. Equal texts have equal fingerprints, whether
    their rows repeat an id or not. An empty table gives no rows. A text is parsed as a whole, in some 60 bytes for
    each character.

    The texts are dealt once, by ranges of ids whose bounds are quantiles; the first document of each range also goes,
    as the text that follows, to the range before. Rows without an id, or with one id, are spread over ranges as well.
    """
    rows = keyed(docs)
    bounds, firsts = range_bounds(rows)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)
    to = F.filter(F.array(F.struct(range_of(bounds).alias("r"), F.lit(False).alias("ahead")), F.struct(_range_before(firsts).alias("r"), F.lit(True).alias("ahead"))), lambda x: x["r"].isNotNull())
    dealt = rows.withColumn("to", F.explode(to)).select("to.r", "to.ahead", "doc_id", "is_null", "text", "h")
    dealt = dealt.repartitionById(firsts[-1][0] + 1, "r").sortWithinPartitions("r", "ahead", "doc_id", "h", F.desc("is_null"), "text")
    return dealt.select("r", "ahead", "doc_id", "is_null", "text").mapInArrow(_pairs, schema)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_rows(documents(spark, sf_dir))
