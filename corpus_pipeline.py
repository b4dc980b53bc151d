"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing and packing over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import documents, written
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.mixing import mix
from quarry.llm.near_dedup import near_dedup
from quarry.llm.packing import pack_rows
from quarry.llm.similar_sets import SHINGLE, SIMILARITY
from quarry.llm.toxicity import drop_toxic

#: (name, function of (spark, docs, sf_dir)); each one's result is written and read again as the next one's docs.
STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: near_dedup(docs, shingle=SHINGLE, similarity=SIMILARITY)),
    ("mixing", lambda spark, docs, sf_dir: mix(docs)),
    ("packing", lambda spark, docs, sf_dir: pack_rows(docs)),
]
#: The stages hash with XXH64 and learn from labels, which DuckDB can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; the last one's rows."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
