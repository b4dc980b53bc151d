"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, written

SHARDS = 24
#: Points of each shard on the ring. The ring has SHARDS * VIRTUAL arcs whatever the input's size.
VIRTUAL = 64


class Ring:
    """Points on a circle of 64-bit hashes; an arc runs from one point up to the next and belongs to the next point's shard."""

    def __init__(self, shards: int, virtual: int = VIRTUAL):
        at = sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}"), s) for s in range(shards) for v in range(virtual))
        self.shards = shards
        self.points = np.array([p for p, _ in at], np.uint64)
        self.owners = np.array([s for _, s in at])

    def arcs(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, position, side="left") % len(self.points)

    def clockwise(self, arc: int) -> list[int]:
        """The shards in the order in which they are met from this arc on."""
        return list(dict.fromkeys(np.roll(self.owners, -arc).tolist()))


def bounded_segments(ring: Ring, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: rows (arc, first, last, shard, slot), `first` and `last` being ranks in the arc
    and `slot` the place in the shard of the key with rank `first`.

    Capacities add up to the number of keys and differ by one at most. In each round every arc, in ring order, offers
    its keys that have no place to the next shard clockwise, which takes what it has room for; the others continue.
    As each arc meets every shard, all keys have a place after as many rounds as there are shards.
    """
    total = sum(counts.values())
    room = [total // ring.shards + (s < total % ring.shards) for s in range(ring.shards)]
    filled = [0] * ring.shards
    order = {a: ring.clockwise(a) for a in sorted(counts)}
    placed = dict.fromkeys(counts, 0)
    out = []
    for turn in range(ring.shards):
        for arc, shards in order.items():
            s = shards[turn]
            if n := min(counts[arc] - placed[arc], room[s] - filled[s]):
                out.append((arc, placed[arc], placed[arc] + n - 1, s, filled[s]))
                placed[arc] += n
                filled[s] += n
    return out


def positions(doc_id: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of integer keys (the finaliser of splitmix64)."""
    x = doc_id.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_rows(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    Law `rows`: the shards' counts differ by one at most. A key starts at its ring position and takes the first shard
    clockwise that isn't full; keys that no capacity turns away stay where the plain ring puts them (`home_shard`).
    Only the arcs' counts, SHARDS * VIRTUAL numbers at most, come to the driver; which keys of an arc overflow follows
    from their rank in the arc by position, id, size and checksum, so reruns agree. Null text has size 8 and checksum
    0; a row without an id stands on the ring by its text's checksum; repeated rows get a slot each. An empty table gives no rows. `grown_shard`
    is null, as it belongs to law `key`.
    """
    ring = Ring(shards, virtual)

    @F.pandas_udf(T.StructType([T.StructField("arc", T.IntegerType()), T.StructField("position", T.LongType())]))
    def place(doc_id):
        import pandas as pd

        at = positions(doc_id.to_numpy())
        return pd.DataFrame({"arc": ring.arcs(at).astype("int32"), "position": at.view(np.int64)})

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("p", place(F.coalesce(F.col("doc_id"), -1 - F.col("text_crc32")))).select("doc_id", "size", "text_crc32", "p.arc", "p.position")
    rows = written(rows, "ring")
    counts = {r["arc"]: r["count"] for r in rows.groupBy("arc").count().collect()}
    segments = bounded_segments(ring, counts)
    arcs = np.array([s[0] for s in sorted(segments)], np.int64)
    first = np.array([s[1] for s in sorted(segments)], np.int64)
    owner = np.array([s[3] for s in sorted(segments)], np.int64)
    slot = np.array([s[4] for s in sorted(segments)], np.int64)
    begins = {int(a): i for i, a in reversed(list(enumerate(arcs)))}  # of each arc, its first segment
    until = {int(a): i + 1 for i, a in enumerate(arcs)}

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("home", T.IntegerType())]))
    def settle(arc, rank):
        import pandas as pd

        arc, rank = arc.to_numpy(), rank.to_numpy()
        which = np.empty(len(arc), np.int64)
        for a in np.unique(arc):
            mine = arc == a
            lo, hi = begins[int(a)], until[int(a)]
            which[mine] = lo + np.searchsorted(first[lo:hi], rank[mine], side="right") - 1
        return pd.DataFrame({"shard": owner[which].astype("int32"), "slot": slot[which] + rank - first[which], "home": ring.owners[arc].astype("int32")})

    w = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    out = ranked.withColumn("s", settle("arc", "rank"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "s.shard", "s.slot", F.lit(None).cast("int").alias("grown_shard"), F.col("s.home").alias("home_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))
