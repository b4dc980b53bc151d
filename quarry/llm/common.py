"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources.folders import scratch

#: The white space that separates words, as bytes of UTF-8 text: `[\x20\x09-\x0D]`.
SPACES = b" \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder. Cuts the lineage; any executor can read it again after a loss."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    give_back()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo `modulus`: the folds of the contracts. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def remainder_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of `text` with A-Z in lower case, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@F.pandas_udf(T.LongType())
def word_count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Number of words `[^\\x20\\x09-\\x0D]+` in a text; 0 for null."""
    count = lambda text: text.map(lambda x: len(x.encode("utf-8", "surrogatepass").split()) if x else 0).astype("int64")
    return trimmed(map(count, parts))


def by_size(texts: pa.StringArray, most: int) -> Iterator[pa.StringArray]:
    """Slices of `texts` in order, of about `most` bytes; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, end - start)
        start = end


def give_back() -> None:
    """Returns to the system the memory that Python, Arrow and the C library keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def trimmed(parts: Iterator) -> Iterator:
    """The same parts; then gives memory back, as a worker outlives its task."""
    yield from parts
    give_back()
