"""Exact deduplication through cuckoo-filter indexes of live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, documents, trimmed, written

SLOTS = 4
MOST_KICKS = 200
#: Digests that a task's index holds, about.
HELD = 250_000


class CuckooIndex:
    """A cuckoo filter whose buckets also hold the digests behind the 16-bit tags.

    A lookup reads the tags of two buckets and compares the stored digest only on a tag hit, so a false positive
    never counts as a copy. Digests can be deleted. An insertion that finds no place after MOST_KICKS evictions
    doubles the table and inserts all stored digests again; nothing is lost on overflow.
    """

    def __init__(self, buckets: int = 1024):
        self.mask = 1
        while self.mask < buckets:
            self.mask *= 2
        self.mask -= 1
        self._clear()

    def _clear(self) -> None:
        n = (self.mask + 1) * SLOTS
        self.tags, self.keys, self.values, self.count = [0] * n, [None] * n, [None] * n, 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(key[:8], "little")
        tag = (h >> 48) or 1
        first = h & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995) & self.mask)

    def _find(self, key: bytes) -> int:
        tag, first, second = self._places(key)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[at] == tag and self.keys[at] == key:
                    return at
        return -1

    def __len__(self) -> int:
        return self.count

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) >= 0

    def get(self, key: bytes):
        at = self._find(key)
        return self.values[at] if at >= 0 else None

    def put(self, key: bytes, value) -> None:
        """Insert `key`, or give it a new value."""
        if (at := self._find(key)) >= 0:
            self.values[at] = value
            return
        if (homeless := self._insert(key, value)) is not None:
            self._grow(homeless)

    def _insert(self, key: bytes, value):
        """None, or the entry that stayed without a place."""
        tag, first, second = self._places(key)
        for bucket in (first, second):
            if self._settle(bucket, tag, key, value):
                return None
        bucket = second
        for kick in range(MOST_KICKS):
            at = bucket * SLOTS + kick % SLOTS
            self.tags[at], tag = tag, self.tags[at]
            self.keys[at], key = key, self.keys[at]
            self.values[at], value = value, self.values[at]
            bucket = self._other(bucket, tag)
            if self._settle(bucket, tag, key, value):
                return None
        return key, value

    def _settle(self, bucket: int, tag: int, key: bytes, value) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.tags[at]:
                self.tags[at], self.keys[at], self.values[at] = tag, key, value
                self.count += 1
                return True
        return False

    def _grow(self, homeless) -> None:
        entries = [*self.items(), homeless]
        while True:
            self.mask = self.mask * 2 + 1
            self._clear()
            if all(self._insert(k, v) is None for k, v in entries):
                return

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; False if it isn't there."""
        if (at := self._find(key)) < 0:
            return False
        self.tags[at], self.keys[at], self.values[at] = 0, None, None
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for t, k, v in zip(self.tags, self.keys, self.values) if t)


def normalised_digest(text: str | None) -> bytes:
    """SHA-256 of the text's UTF-8 without `[\\x20\\x09-\\x0D]`. Null counts as empty."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").translate(None, SPACES)).digest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([normalised_digest(t) for t in texts], pa.binary()), b.column(2)],
            names=["doc_id", "n_chars", "digest", "text_hash"],
        )


def _rank(row) -> tuple:
    """Larger is better: most code points, then the smallest id (null last), then the smallest row tag."""
    n_chars, doc_id, tag = row
    return n_chars, doc_id is not None, -(doc_id or 0), -tag


def _fold(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Groups of the rows of one task: a row (digest, n_chars, doc_id, tag, n) for each live digest.

    With `most`, the groups are handed on and forgotten whenever there are so many.
    """
    index = CuckooIndex()
    for b in batches:
        if most and len(index) > most:
            yield from _groups(index)
            index = CuckooIndex()
        for key, n_chars, doc_id, tag, n in zip(*(b.column(c).to_pylist() for c in ("digest", "n_chars", "doc_id", "tag", "n"))):
            entry, old = (n_chars, doc_id, tag), index.get(key)
            if old is None:
                index.put(key, (entry, n))
            else:
                index.put(key, (max(old[0], entry, key=_rank), old[1] + n))
    yield from _groups(index)


def _groups(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    entries = list(index.items())
    for i in range(0, len(entries), 20_000):
        part = entries[i : i + 20_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[0][c] for _, v in part], pa.int64()) for c in range(3)), pa.array([v[1] for _, v in part], pa.int64())],
            names=["digest", "n_chars", "doc_id", "tag", "n"],
        )


GROUP_SCHEMA = "digest binary, n_chars long, doc_id long, tag long, n long"


def dedup_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, n_chars, digest, text_hash, keep_id, group_size, kept.

    Texts are equal when they are identical without `[\\x20\\x09-\\x0D]`; null counts as empty. The row with the most
    code points in the original text stays, then the smallest doc_id (null last); of rows that repeat both, one.
    Other columns are ignored. An empty table gives no rows.

    Each task folds its own rows in a cuckoo index, so a group of copies leaves a task as one row however large it
    is; the tasks' groups then meet by digest in a second index. The rows get their group by a join on the digest,
    which Spark splits where one group is very large.
    """
    # not the row's position in the input, which a lost executor may change: the table that is written fixes it
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    rows = rows.mapInArrow(lambda it: trimmed(_digests(it)), "doc_id long, n_chars long, digest binary, text_hash long").withColumn("tag", F.monotonically_increasing_id())
    rows = written(rows, "digests")
    local = rows.select("digest", "n_chars", "doc_id", "tag", F.lit(1).cast("long").alias("n")).mapInArrow(lambda it: trimmed(_fold(it, HELD)), GROUP_SCHEMA)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // HELD))
    groups = local.repartition(tasks, "digest").mapInArrow(lambda it: trimmed(_fold(it)), GROUP_SCHEMA)
    groups = groups.select("digest", F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("n").alias("group_size"))
    return rows.join(groups.hint("merge"), "digest").select("doc_id", "n_chars", "digest", "text_hash", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"))


def keep_rows(docs: DataFrame, fate: DataFrame) -> DataFrame:
    """The rows of `docs` that `fate` (doc_id, text_hash, kept), a row for each of them, keeps; all columns stay.

    Rows that repeat both the id and the text are told apart by nothing that `fate` holds: if one of them is kept, the
    one whose columns have the smallest hash stays. What is compared with the rows are the keys that go and those that
    repeat, so the texts are moved only where these are too many for the optimizer to send to every task.
    """
    key = lambda i, h: (F.coalesce(i.cast("long"), F.lit(0)).alias("id"), i.isNull().alias("no_id"), h.alias("hash"))
    keys = fate.groupBy(*key(F.col("doc_id"), F.col("text_hash"))).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(keys.where("NOT kept OR n > 1"), "fate")
    rows = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    rows = rows.select("row", *key(F.col("row.doc_id"), F.xxhash64(F.col("row.text").cast("string"))))
    repeated = rows.join(keys.where("kept"), ["id", "no_id", "hash"], "left_semi").groupBy("id", "no_id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(keys, ["id", "no_id", "hash"], "left_anti").select("row").union(repeated.select("row")).select("row.*")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """`docs` without copies, with all its columns; see `dedup_rows` for which row stays."""
    return keep_rows(docs, dedup_rows(docs).select("doc_id", "text_hash", "kept"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_rows(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
