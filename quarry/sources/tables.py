"""Tables from files and other sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names of the tables of a data directory, a Parquet file or folder each.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def parquet(spark: SparkSession, folder: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def source(spark: SparkSession, kind: str, path: str | None = None, **options) -> DataFrame:
    """A table from any source that Spark reads: csv, json, orc, avro, jdbc, a table format."""
    reader = spark.read.format(kind).options(**options)
    return reader.load(path) if path else reader.load()


def memory(spark: SparkSession, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)
