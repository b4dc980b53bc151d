"""Language identification by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, remainder, written

#: Training documents for each language, at most.
SAMPLE = 1500
#: Length of the n-grams in letters; a space stands for what isn't a letter.
N = 4
#: An n-gram is a language's own from this share of the rate that it has in the language where it is most frequent.
OWN = 0.25
#: Positions of a filter for each n-gram of the language that has most, at least, and hash functions.
ROOM, HASHES = 12, 3
#: Characters of a text that are looked at together.
PIECE = 262_144
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else a space."""
    global _letters
    if _letters is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                table[c] = ord(low) if len(low := x.lower()) == 1 else c
        _letters = table
    return _letters


def gram_parts(text: str | None, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Hashes (uint64) of all n-grams of a whole text, repeats included, runs of non-letters being one space; a part for each `piece` characters."""
    carried = np.array([32], np.uint64)  # a text begins and ends as if with a non-letter
    seen = given = False
    for start in range(0, len(text or ""), piece):
        x = letters()[np.frombuffer(text[start : start + piece].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        if start + piece >= len(text):
            x = np.append(x, np.uint64(32))
        x = np.concatenate((carried, x))
        space = x == 32
        seen = seen or not space.all()
        x = x[np.concatenate(([True], ~(space[1:] & space[:-1])))]
        # a text of fewer symbols than an n-gram has one of all its symbols
        n = min(N, len(x)) if start + piece >= len(text) and not given else N
        carried = x[max(0, len(x) - N + 1) :]
        if not seen or len(x) < n:
            continue
        given = True
        h = x[: len(x) - n + 1].copy()
        for i in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - n + 1 + i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        yield h ^ (h >> np.uint64(32))


def grams(text: str | None) -> np.ndarray:
    """All parts of `gram_parts`."""
    return np.concatenate([np.empty(0, np.uint64), *gram_parts(text)])


class Filters:
    """One Bloom filter for each language, sliced by position: a word of `slices` holds a bit for each language.

    A lookup ands the words at an n-gram's positions, which gives the set of all languages whose filter has the n-gram.
    `false_rate` is each filter's chance to claim an n-gram that it doesn't hold, from its share of set bits.
    """

    def __init__(self, profiles: dict[str, np.ndarray], positions: int | None = None, hashes: int = HASHES):
        self.langs = sorted(profiles)
        # a power of two with room for the language that has most n-grams
        positions = positions or 1 << (ROOM * max(map(len, profiles.values()), default=1)).bit_length()
        self.mask, self.hashes = np.uint64(positions - 1), hashes
        self.words = -(-len(self.langs) // 64)
        self.slices = np.zeros((self.words, positions), np.uint8 if len(self.langs) <= 8 else np.uint64)
        for i, lang in enumerate(self.langs):
            for at in self._places(profiles[lang]):
                self.slices[i // 64][at] |= self.slices.dtype.type(1 << i % 64)
        fill = [float(((self.slices[i // 64] >> self.slices.dtype.type(i % 64)) & self.slices.dtype.type(1)).mean()) for i in range(len(self.langs))]
        self.false_rate = np.array(fill) ** hashes

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(40)) | np.uint64(1)
        return [((h + np.uint64(k) * step) & self.mask).astype(np.int64) for k in range(self.hashes)]

    def counts(self, h: np.ndarray) -> np.ndarray:
        """For each language how many of the n-grams its filter has, corrected for false positives."""
        places = self._places(h)
        out = np.zeros(len(self.langs))
        for w in range(self.words):
            held = self.slices[w][places[0]]
            for at in places[1:]:
                held &= self.slices[w][at]
            if self.slices.dtype == np.uint8:
                sets = np.bincount(held, minlength=256)
                for i in range(len(self.langs)):
                    out[i] = sets[(np.arange(256) >> i) & 1 == 1].sum()
            else:
                for i in range(w * 64, min(len(self.langs), w * 64 + 64)):
                    out[i] = int(((held >> np.uint64(i % 64)) & np.uint64(1)).sum())
        return np.maximum(0.0, (out - len(h) * self.false_rate) / (1 - self.false_rate))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the language with most n-grams; the score is its share against the runner-up's, 0.5 to 1.

        UNKNOWN and 0 for a text that is null or has no letter; ties go to the first language by name.
        """
        counts, any_gram = np.zeros(len(self.langs)), False
        for h in gram_parts(text) if self.langs else ():
            counts, any_gram = counts + self.counts(h), True
        if not any_gram:
            return UNKNOWN, 0.0
        order = np.argsort(-counts, kind="stable")
        first, second = counts[order[0]], counts[order[1]] if len(order) > 1 else 0.0
        return self.langs[order[0]], float(first / (first + second)) if first else 1 / len(self.langs)


def fit(docs: DataFrame) -> Filters:
    """Filters for the languages of `docs` (doc_id, text, lang) outside the held-out fold.

    Learns from about SAMPLE documents a language at most, chosen by a hash of their id, and holds all their n-grams that
    are the language's own: an n-gram belongs to each language in which it is at least OWN times as frequent as in the
    language that has it most. Null languages and texts without letters are left out. What comes to the driver is
    bounded by the number of languages and SAMPLE.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(remainder(F.col("doc_id"), 4) != 2)
    # the threshold that leaves about SAMPLE documents of a language, from their numbers; no language is sorted in one task
    # (written, so that the optimizer knows how few they are and sends them to the texts)
    numbers = written(own.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows")), "languages")
    picked = own.join(numbers, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**30)) < F.lit(SAMPLE * 2**30) / F.col("rows"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def flush():
            for lang, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = grams(text)
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = picked.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(total, "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("most", most).where(F.col("rate") >= OWN * F.col("most")).select("lang", "gram").toArrow().combine_chunks()
    lang, gram = kept["lang"].to_pandas(), kept["gram"].to_numpy().view(np.uint64)
    return Filters({k: gram[at] for k, at in lang.groupby(lang).indices.items()})


def language_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    The prediction depends on the text alone; rows that repeat an id or a text are predicted each. An empty table, or one
    without languages, gives UNKNOWN for every row. A very long text is looked at in pieces of PIECE characters.
    """
    filters = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text):
        import pandas as pd

        return pd.DataFrame([filters.value.predict(t) for t in text], columns=["lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "p.lang_pred", "p.score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_rows(documents(spark, sf_dir))
