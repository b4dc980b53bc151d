"""Mixing sources to target weights by whole and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, word_count, written

#: Weights that the sources, in order of code point with null last, take in turn.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and the most a source repeats.
SHARE, MOST = 1.5, 2
#: Hash seeds of which each source uses the one whose Bernoulli copies come nearest its target.
SEEDS = 8


def _uniform(seed: int):
    """A number in [0, 1) fixed by the document's id and the seed: 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source of `sized` (source, size).

    The sources share `share` of all sizes by weight; a target stops at `most` times its source's size and what is
    above goes to the others by weight, again and again: there is one level l with target = min(most * size, l * weight).
    Both windows run over one row for each source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", w)
    # sources that stop first come first; at each, the level if all before it have stopped
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.withColumns({
        "capped": F.coalesce(F.sum("source_size").over(so_far), F.lit(0)),
        "left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)),
        "all": F.sum("source_size").over(whole),
    })
    level = (F.lit(float(share)) * F.col("all") - F.lit(float(most)) * F.col("capped")) / F.col("left")
    totals = totals.withColumn("level", level).withColumn("fits", F.lit(float(most)) * F.col("source_size") >= F.col("level") * F.col("weight"))
    # the level rises while sources stop and falls after the first that fits
    level = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    at_most = F.lit(float(most)) * F.col("source_size")
    return totals.select("source", "source_size", F.coalesce(F.least(at_most, level * F.col("weight")), at_most).alias("target"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    A document of a source with rate r = target / source_size is emitted floor(r) times, and once more where its
    hash-seeded uniform number is under r's fraction. Each source uses that one of SEEDS seeds whose copies come
    nearest its target; this needs SEEDS sums for each source and keeps the mix the same in every run. Null text has
    size 0; null sources are one source, the last. A source of size 0 has target and copies 0. An empty table gives no
    rows. Rows that repeat an id draw alike.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = written(sized, "sizes")
    rates = source_targets(sized).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = written(rates.withColumnRenamed("source", "__source"), "rates")
    fraction = F.col("rate") - F.floor("rate")
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    sums = rated.groupBy("__source").agg(*(F.sum(F.when(_uniform(k) < fraction, F.col("size")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)))
    off = [F.abs(F.floor("rate") * F.col("source_size") + F.col(f"s{k}") - F.col("target")) for k in range(SEEDS)]
    best = F.array_min(F.array(*(F.struct(o.alias("off"), F.lit(k).alias("seed")) for k, o in enumerate(off))))["seed"]
    seeds = rates.join(sums.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).select("__source", "source_size", "target", "rate", best.alias("seed"))
    drawn = F.element_at(F.array(*(_uniform(k) for k in range(SEEDS))), F.col("seed") + 1)
    copies = (F.floor("rate") + F.when(drawn < fraction, 1).otherwise(0)).cast("long")
    out = sized.join(seeds, F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of `docs`, with all its columns, as often as `mix_rows` says."""
    rows = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    times = mix_rows(docs).where("copies > 0").select(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("copies").cast("int").alias("n"))
    times = times.dropDuplicates(["id", "of"])  # rows that repeat an id and a source draw alike
    on = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & F.col("row.source").cast("string").eqNullSafe(F.col("of"))
    return rows.join(times, on).select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


_DRAW = "CAST('0x' || substr(md5('{k}:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate)"
OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight
  FROM sized GROUP BY source),
laid AS (
  SELECT *, coalesce(sum(source_size) OVER b, 0)::DOUBLE AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
         CAST(sum(source_size) OVER () AS DOUBLE) AS everything
  FROM totals
  WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5::DOUBLE * everything - 2.0::DOUBLE * capped) / rest::DOUBLE AS level FROM laid),
one AS (SELECT max(level) AS level FROM levels WHERE 2.0::DOUBLE * source_size >= level * weight),
rates AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, one.level * weight) AS target,
         CASE WHEN source_size > 0 THEN least(2.0::DOUBLE * source_size, one.level * weight) / source_size ELSE 0 END AS rate
  FROM levels, one),
sums AS (
  SELECT r.source, r.source_size, r.target, r.rate,
         {", ".join(f"sum(CASE WHEN {_DRAW.format(k=k)} THEN size ELSE 0 END) AS s{k}" for k in range(SEEDS))}
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source GROUP BY r.source, r.source_size, r.target, r.rate),
offs AS (SELECT *, {", ".join(f"abs(floor(rate) * source_size + s{k} - target) AS o{k}" for k in range(SEEDS))} FROM sums),
seeds AS (SELECT *, list_position([{", ".join(f"o{k}" for k in range(SEEDS))}], least({", ".join(f"o{k}" for k in range(SEEDS))})) AS seed FROM offs),
drawn AS (
  SELECT doc_id, size, r.source_size, r.target, s.source,
         CAST(floor(r.rate) AS BIGINT) + CASE WHEN [{", ".join(_DRAW.format(k=k) for k in range(SEEDS))}][r.seed] THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN seeds r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM drawn
"""
