"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, documents, give_back, remainder, trimmed

#: Labelled rows of each label that examples are taken from, about, at most and (of the more frequent label) at least;
#: bounds the model's size and the driver's part.
PER_LABEL, LEAST = 1500, 256
#: Numbers of neighbours of which cross-validation on the training fold chooses one.
NEAREST = (16, 32, 64, 128, 256, 512)
#: Weight of the even prior beside the neighbours' cosines, so that one chance neighbour doesn't decide.
PRIOR = 2.0
#: Letters of a word's stem; longer words are counted under both.
STEM = 4
#: Examples of a block of the index, share of the examples from which a term's list is kept dense, and texts scored together.
BLOCK, DENSE, TOGETHER = 128, 0.05, 64
#: Bytes of text whose terms are counted together.
BYTES = 2_000_000


def term_counts(texts: pa.StringArray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, text, term, n): the different terms of some texts, and for each text and each term that it has how often.

    A text's terms are its words (runs of letters, lower case), as often as they occur, and `abcd-` for each different
    longer word that begins with abcd, which words with one stem share. Null has none. Takes some ten times the
    texts' bytes.
    """
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " "))
    coded = lists.values.dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    del lists
    words = coded.dictionary.to_pylist()
    pairs, n = np.unique(text * len(words) + coded.indices.to_numpy(), return_counts=True)
    del coded
    text, word = np.divmod(pairs, max(1, len(words)))
    if "" in words:  # stands before a leading blank
        text, word, n = (x[word != words.index("")] for x in (text, word, n))
    stems: dict[str, int] = {}
    stem_of = np.array([stems.setdefault(w[:STEM] + "-", len(stems)) if len(w) > STEM else -1 for w in words], np.int64)
    stem = stem_of[word]
    pairs, stem_n = np.unique((text * len(stems) + stem)[stem >= 0], return_counts=True)
    stem_text, stem = np.divmod(pairs, max(1, len(stems)))
    return words + list(stems), np.append(text, stem_text), np.append(word, stem + len(words)), np.append(n, stem_n)


def places(terms: list[str], known: pa.StringArray) -> np.ndarray:
    """The place of each term in `known`, -1 if it isn't there. Strings in one array take a sixth of what a dictionary of them does."""
    return pc.fill_null(pc.index_in(pa.array(terms, pa.string()), value_set=known), -1).to_numpy().astype(np.int64)


class Vocabulary:
    """All terms of the examples and their inverse document frequencies; turns texts into TF-IDF vectors of length 1.

    A vector is (term ids in ascending order, weights (1 + ln tf) * idf over its length); empty without a known term.
    """

    def __init__(self, terms: pa.StringArray, df: np.ndarray, rows: int):
        self.terms = terms
        self.idf = np.log((rows + 1) / np.clip(df, 1, rows)) if len(df) else np.empty(0)

    def weighted(self, many: int, text: np.ndarray, term: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The vectors of `many` texts from their counts: of text[i] the term id term[i], below 0 if unknown, n[i] times."""
        text, term, n = (x[term >= 0] for x in (text, term, n))
        order = np.argsort(text * len(self.terms) + term)
        text, term = text[order], term[order]
        x = (1 + np.log(n[order])) * self.idf[term]
        x /= np.sqrt(np.bincount(text, x * x, many))[text]
        cuts = np.searchsorted(text, np.arange(many + 1)).tolist()
        return [(term[a:b], x[a:b]) for a, b in zip(cuts, cuts[1:])]

    def vectors(self, texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in by_size(texts, BYTES):
            terms, text, term, n = term_counts(part)
            term = places(terms, self.terms)[term] if len(terms) else term
            del terms
            found = self.weighted(len(part), text, term, n)
            # a task scores for long: neither what the counting took nor the counts stay meanwhile
            del text, term, n
            pa.default_memory_pool().release_unused()
            yield from found


class BlockMaxIndex:
    """Inverted lists over example vectors; each list is cut in blocks of BLOCK examples and carries each block's largest weight.

    The lists of terms that many examples have are rows of a dense matrix, whose part of all cosines is one product for
    several queries. A block's cosines are bounded by the largest dense part in it and the block maxima of the query's
    other terms. The blocks with the highest bounds are scored first, as many as hold k examples twice; then those
    whose bound reaches the k-th best cosine so far. The rest is never read, and the result is exact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.size = len(vectors)
        self.blocks = -(-self.size // BLOCK)
        term = np.concatenate([ids for ids, _ in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([x for _, x in vectors]) if vectors else np.empty(0)
        example = np.repeat(np.arange(self.size), [len(ids) for ids, _ in vectors])
        many = np.flatnonzero(np.bincount(term, minlength=terms) >= max(1, DENSE * self.size))
        self.row = np.full(terms, -1, np.int32)
        self.row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), self.size), np.float32)
        heavy = self.row[term] >= 0
        self.dense[self.row[term[heavy]], example[heavy]] = weight[heavy]
        term, weight, example = term[~heavy], weight[~heavy], example[~heavy]
        order = np.argsort(term, kind="stable")  # a term's examples stay in ascending order
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order].astype(np.float32)
        # a run is a term's part in one block
        key = term * max(1, self.blocks) + self.example // BLOCK
        self.start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.length = np.diff(np.append(self.start, len(key))).astype(np.int32)
        self.block = self.example[self.start] // BLOCK
        self.start = self.start.astype(np.int32)
        self.peak = np.maximum.reduceat(self.weight, self.start) if len(key) else np.empty(0, np.float32)
        self.runs = np.searchsorted(term[self.start], np.arange(terms + 1))

    @staticmethod
    def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """start[0], start[0] + 1, ... (length[0] numbers), start[1], ..."""
        ends = np.cumsum(length)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (cosines, examples) of the k examples with the largest positive cosine, best first, ties by example."""
        given = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (ids, q) in enumerate(queries):
            row = self.row[ids]
            given[i, row[row >= 0]] = q[row >= 0]
        parts = given @ self.dense
        padded = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        padded[:, : self.size] = parts
        tops = padded.reshape(len(queries), self.blocks, BLOCK).max(2)
        return [self._nearest(*query, k, part, top) for query, part, top in zip(queries, parts, tops)]

    def _nearest(self, ids: np.ndarray, q: np.ndarray, k: int, score: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        light = self.row[ids] < 0
        ids, q = ids[light], q[light].astype(np.float32)
        runs = self._spread(self.runs[ids], many := self.runs[ids + 1] - self.runs[ids])
        q = np.repeat(q, many)
        block, start, length = self.block[runs], self.start[runs], self.length[runs]
        bound = np.bincount(block, q * self.peak[runs], self.blocks) + top + 1e-5
        wanted = np.zeros(self.blocks, bool)
        wanted[np.argsort(-bound, kind="stable")[: -(-2 * k // BLOCK)]] = True
        first = wanted
        while True:
            here = wanted[block]
            at = self._spread(start[here], length[here])
            score = score + np.bincount(self.example[at], np.repeat(q[here], length[here]) * self.weight[at], self.size)
            if wanted is not first or first.all():
                break
            # what is known of the unread blocks' cosines is a lower bound too
            least = np.partition(score, self.size - k)[self.size - k] if self.size > k else 0.0
            wanted = ~first & (bound >= least)
        score = score.round(6)
        found = np.flatnonzero(score > 0)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((found, -score[found]))][:k]
        return score[found], found


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, y) of the rising step function nearest to the points by weighted least squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    at, whose = np.unique(x, return_inverse=True)
    for a, b, c in zip(at.tolist(), np.bincount(whose, y * w).tolist(), np.bincount(whose, w).tolist()):
        pools.append([a * c, b, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    """Scores a text by the votes of its nearest labelled examples, weighted by cosine.

    The number of neighbours and the calibration (isotonic, against the labels' frequencies in the training fold) come
    from leave-one-out votes of the examples among themselves; held-out rows have no part in them.
    """

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], numbers: tuple[int, int]):
        """Examples' ids, labels and vectors; `numbers` of rows labelled 0 and 1 in the training fold."""
        # like texts stand together, so that blocks differ: by their heaviest term, then by their number of terms
        best = lambda v: int(v[0][v[1].argmax()]) if len(v[0]) else -1
        order = sorted(range(len(ids)), key=lambda e: (best(vectors[e]), len(vectors[e][0]), ids[e], toxic[e], *(x.tobytes() for x in vectors[e])))
        vectors = [vectors[e] for e in order]
        self.vocabulary = vocabulary
        self.ids = ids[order].astype(np.int64)
        self.toxic = toxic[order].astype(np.float64)
        self.index = BlockMaxIndex(vectors, len(vocabulary.terms))
        self.even = float(self.toxic.mean()) if len(ids) else 0.0
        self.plain = numbers[1] / max(1, sum(numbers))
        self.k, self.knots = NEAREST[0], None
        if 0 < self.even < 1:
            self._calibrate(vectors, numbers)

    def _votes(self, cosines: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The share of toxic votes among the first 1, 2, ... neighbours."""
        return (np.cumsum(cosines * self.toxic[near]) + PRIOR * self.even) / (np.cumsum(cosines) + PRIOR)

    def _calibrate(self, vectors: list, numbers: tuple[int, int]) -> None:
        votes = np.full((len(NEAREST), len(vectors)), self.even)
        found = (n for i in range(0, len(vectors), TOGETHER) for n in self.index.nearest(vectors[i : i + TOGETHER], max(NEAREST) + 1))
        for e, (cosines, near) in enumerate(found):
            others = near != e
            if len(shares := self._votes(cosines[others], near[others])):
                votes[:, e] = shares[np.minimum(NEAREST, len(shares)) - 1]
        each = np.array([n / max(1, int((self.toxic == i).sum())) for i, n in enumerate(numbers)])
        w = each[self.toxic.astype(int)]
        best = -1.0
        for k, v in zip(NEAREST, votes):
            x, y = isotonic(v, self.toxic, w)
            said = np.interp(v, x, y) >= 0.5
            f1 = 2 * w[said & (self.toxic > 0)].sum() / (w[said].sum() + w[self.toxic > 0].sum())
            if f1 > best:
                best, self.k, self.knots = f1, k, (x, y)

    def scores(self, texts: pa.StringArray) -> Iterator[tuple[float, list[int]]]:
        """(score, ids of the nearest examples) of each text. One that shares no term with an example gets the labels' frequency."""
        if not self.index.size:
            yield from ((self.plain, []) for _ in texts)
            return
        for part in batched(self.vocabulary.vectors(texts), TOGETHER):
            for cosines, near in self.index.nearest(part, self.k):
                score = self.plain if self.knots is None or not len(near) else float(np.interp(self._votes(cosines, near)[-1], *self.knots))
                yield score, self.ids[near[:3]].tolist()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from `labels` (doc_id, toxic) on rows of `docs` (doc_id, text) outside the held-out fold.

    Examples: of each label about as many documents as the rarer one has, PER_LABEL at most, chosen by a hash of their
    id. The vocabulary is every term of the examples; document frequencies are counted over all of `docs`. What comes
    to the driver are the examples' terms and one number for each of them. Labels that are null are ignored; an id
    labelled more than once is toxic if any of its labels is; rows that repeat a labelled id are an example each; a
    null or empty text is an example without terms. Without labels, or with one label only, every score is that
    label's frequency (0 without labels).
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("doc_id"), 5) != 0)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic"))
    found = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    numbers = found.get(0, 0), found.get(1, 0)
    most = min(PER_LABEL, max(LEAST, min(numbers)))
    shares = [math.ceil(min(1.0, most / max(1, n)) * 2**30) for n in numbers]
    picked = labels.where(F.pmod(F.xxhash64("id"), F.lit(2**30)) < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # PER_LABEL rows of each label at most, about
    sample = texts.join(F.broadcast(spark.createDataFrame([tuple(r) for r in picked.collect()], "id long, toxic int")), F.col("doc_id") == F.col("id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = 0
            for part in by_size(b.column(0), BYTES):
                terms, text, term, n = term_counts(part)
                order = np.argsort(text, kind="stable")
                cuts = pa.array(np.searchsorted(text[order], np.arange(len(part) + 1)).astype(np.int32))
                named = pa.array(terms, pa.string()).take(pa.array(term[order]))
                lists = pa.ListArray.from_arrays(cuts, named), pa.ListArray.from_arrays(cuts, pa.array(n[order].astype(np.int32)))
                rest = (b.column(c).slice(start, len(part)) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([*lists, *rest], names=["terms", "n", "doc_id", "toxic"])
                start += len(part)

    held = sample.select("text", "doc_id", "toxic").mapInArrow(lambda it: trimmed(counted(it)), "terms array<string>, n array<int>, doc_id long, toxic int").toArrow().combine_chunks()
    # the examples' terms by rank, as arrays: the driver holds no object for each
    lists = held["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    rank = pc.sort_indices(coded.dictionary).to_numpy()
    terms = coded.dictionary.take(pa.array(rank))
    place = np.empty(len(terms), np.int64)
    place[rank] = np.arange(len(terms))
    counts = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), place[coded.indices.to_numpy()], held["n"].combine_chunks().flatten().to_numpy()
    ids, toxic = held["doc_id"].to_numpy(), held["toxic"].to_numpy()
    del held, lists, coded
    known = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known.value) + 1, np.int64)  # the last is for other terms, then for the rows
        rows = 0
        for b in batches:
            for part in by_size(b.column(0), BYTES):
                found, _, term, _ = term_counts(part)
                np.add.at(df, places(found, known.value), np.bincount(term, minlength=len(found)))
            rows += b.num_rows
        df[-1] = rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "n"])

    df = np.zeros(len(terms) + 1, np.int64)
    found = texts.select("text").mapInArrow(lambda it: trimmed(frequencies(it)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    vocabulary = Vocabulary(terms, df[:-1], int(df[-1]))
    vectors = vocabulary.weighted(len(ids), *counts)
    known.unpersist()
    del counts, found, known, terms
    give_back()
    model = Model(vocabulary, ids, toxic, vectors, numbers)
    del vectors
    give_back()
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` and `evidence` (ids of the nearest examples); the score depends on the text alone.

    A null text scores as an empty one. Other columns pass through; columns of these two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("score double, evidence array<long>")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.int64()))])
        return trimmed(pa.array([{"score": s, "evidence": e} for s, e in shared.value.scores(text)], kind) for text in parts)

    rows = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    rows = rows.select("row", scored(F.col("row.text").cast("string")).alias("of"))
    kept = [c for c in docs.columns if c.lower() not in ("score", "evidence")]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), F.col("of.score").alias("score"), F.col("of.evidence").alias("evidence"))


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score, predicted, evidence.

    Null and empty texts get the labels' frequency. Rows that repeat an id or a text are scored each; equal texts score
    alike. Neighbours that tie are taken in the index's order, which rests on the examples' terms and ids. A very long
    text costs its different terms. An empty table gives no rows; see `fit` for labels.
    """
    out = score_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` with a score under 0.5, with all their columns, whatever their names; repeated rows stay repeated."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(pa.array((s for s, _ in shared.value.scores(text)), pa.float64()) for text in parts)

    rows = docs.select(F.struct("*").alias("row"))
    return rows.where(scored(F.col("row.text").cast("string")) < 0.5).select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
