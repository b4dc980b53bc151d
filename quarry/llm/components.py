"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


#: An end of more than this part of all edges is a hub.
SHARE = 64


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for every node of `edges` (a, b bigint) the smallest node it can reach.

    Alternates large-star and small-star, which need O(log n) rounds of aggregations and joins; the edge list stays
    distributed and is written to the shared folder after each round, so a lost executor costs at most one round. Self
    loops and repeated edges do no harm; no edges give no rows.

    Only minima are aggregated. Nodes with more than a SHARE-th of all edges at one side, twice SHARE at most, don't go
    through the joins: their minima are a table of that many rows, which every task has.
    """
    now = written(_canonical(edges.select("a", "b")), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if state == before:
            break
        before = state
        ends = now.select(F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("node")) for s in "ab"))).alias("end")).select("end.*")
        often = ends.groupBy("side", "node").count().where(F.col("count") > state[0] / SHARE).collect()
        hubs = {side: [r["node"] for r in often if r["side"] == side] for side in "ab"}
        now = written(_canonical(_small_star(_large_star(now, hubs["b"]), hubs["a"])), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller, without loops; tasks drop their own repeats before edges are dealt."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _with_least(edges: DataFrame, side: str, hubs: list[int]) -> DataFrame:
    """`edges` with m, the smallest of the smaller neighbours of the node at `side` (null if it has none)."""
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    if not hubs:
        return edges.join(least, F.col(side) == F.col("node"), "left").select("a", "b", "m")
    many, hub = F.col(side).isin(hubs), F.col("node").isin(hubs)
    others = edges.where(~many).join(least.where(~hub), F.col(side) == F.col("node"), "left")
    # SHARE rows at most
    return others.union(edges.where(many).join(F.broadcast(least.where(hub)), F.col(side) == F.col("node"), "left")).select("a", "b", "m")


def _large_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    return _with_least(edges, "b", hubs).select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    met = _with_least(edges, "a", hubs)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))


def labelled(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` (doc_id, fp, text_hash) with the label of their node and the smallest doc_id under that label.

    `nodes` are (fp, least: smallest doc_id). A node with very many rows is split by Spark in the last join.
    """
    linked = written(nodes.join(labels, nodes.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labels")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    of = linked.join(ids, "label").select(F.col("fp").alias("f"), "label", "component_id")
    return rows.join(of.hint("merge"), F.col("fp") == F.col("f")).select("doc_id", "fp", "text_hash", "label", "component_id")
