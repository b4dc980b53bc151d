"""Token ids of whole documents in Arrow files of equal-length sequences with masks."""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, documents, scratch, written
from quarry.llm.fingerprint import keyed, range_bounds, range_of

#: Ids of a sequence, sequences of a record batch, and the id that ends each document.
LENGTH, BATCH, END = 2048, 64, 1
#: Pieces that a worker remembers, and bytes of text that it encodes together.
REMEMBERED, TOGETHER = 600_000, 8_000_000
#: The tokenizer's normalizer, its pattern of pieces and the end of a piece's last token.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END_OF_PIECE = "</w>"
#: The pieces that aren't runs of letters; blanks around them leave all pieces between blanks.
_APART = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters beyond U+02FF, which may compose, controls, and those that Arrow lowers otherwise; the beginning of special tokens.
_UNSURE = "[^\t\n\r -~\u00a1-\u02ff]|\u0130|<[|]"


class Encoder:
    """Encodes whole texts with a tokenizer file, by pieces where the tokenizer is the one this module knows.

    Texts without a character of _UNSURE are lowered and cut in pieces by Arrow, many texts at once; each different
    piece is looked up in a bounded memory, and those that are new go to the library, joined by blanks, as pieces never
    reach over white space: the tokens that end a piece tell them apart again. All other texts, and all texts with any
    other tokenizer, go to the library as they are.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 2**16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern")
        self.by_pieces = normal == _NORMALIZER and cut == {"Regex": _PIECE} and spec["model"].get("end_of_word_suffix") == _END_OF_PIECE
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(_END_OF_PIECE)]] = True
        # what was met lately, and what was met before that; the older half goes when the newer is full
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 500):
            part = pieces[i : i + 500]
            ids = self._library([" ".join(part)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the tokenizer's pieces don't end as this module expects")
            width, raw = self.dtype.itemsize, ids.tobytes()
            bounds = [0, *(cuts * width).tolist()]
            out += [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def _codes(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some different pieces."""
        found = list(map(self.young.get, pieces))
        if gaps := [i for i, v in enumerate(found) if v is None]:
            for i in gaps:
                found[i] = self.old.get(pieces[i])
            new = [i for i in gaps if found[i] is None]
            for i, v in zip(new, self._learn([pieces[i] for i in new])):
                found[i] = v
            if len(self.young) > REMEMBERED // 2:
                self.old, self.young = self.young, {}
            self.young.update((pieces[i], found[i]) for i in gaps)
        return found

    def _pieces(self, texts: pa.StringArray) -> list[np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \0 "))
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        blank = pieces.index("") if "" in pieces else None
        codes = self._codes(pieces if blank is None else pieces[:blank] + pieces[blank + 1 :])
        if blank is not None:
            codes.insert(blank, b"")
        known = np.frombuffer(b"".join(codes), self.dtype)
        lengths = np.fromiter(map(len, codes), np.int64, len(codes)) // self.dtype.itemsize
        at = coded.indices.to_numpy()
        n = lengths[at]
        ends = np.cumsum(n)
        ids = known[np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(lengths) - lengths)[at] - (ends - n), n)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """For each text its ids. Takes some ten times TOGETHER bytes, or the longest text's, at a time."""
        for part in by_size(texts, TOGETHER):
            sure = pc.invert(pc.match_substring_regex(part, _UNSURE)) if self.by_pieces else pa.array([False] * len(part))
            plain = iter(self._pieces(pa.concat_arrays([part.filter(sure)])))
            other = iter(self._library(part.filter(pc.invert(sure)).to_pylist()))
            for is_sure in sure.to_pylist():
                yield next(plain if is_sure else other)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Schemes of folders that pyarrow opens, by the scheme that Spark names them with.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3a": "s3", "s3": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def store_folder(spark: SparkSession, folder: str) -> str:
    """The folder, created, as the URI under which pyarrow finds what Spark finds there.

    Resolved by Hadoop, so a path without a scheme is the cluster's own and a view is what it stands for. Fails at once
    where pyarrow has no file system for it.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    uri = fs.resolvePath(where).toUri()
    scheme = _SCHEMES.get(uri.getScheme())
    if scheme is None:
        raise ValueError(f"token files can't be written below {uri}: use a folder of one of {sorted(_SCHEMES)}")
    return f"{scheme}://{uri.getAuthority() or ''}{uri.getPath()}"


def _file_system(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Writes ids into sequences of LENGTH, BATCH to a record batch; the last sequence is filled up and masked.

    The file has its final name, which is new for each attempt, only in the manifest: what a lost executor leaves
    behind is never read.
    """

    def __init__(self, path: str, dtype: np.dtype, length: int = LENGTH):
        system, where = _file_system(path)
        system.create_dir(os.path.dirname(where), recursive=True)
        self.length, self.dtype = length, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = system.open_output_stream(where)
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.held, self.size, self.total = [], 0, 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.size >= self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        whole = self.length * BATCH
        at = 0
        while len(ids) - at >= whole:
            self._write(ids[at : at + whole], whole)
            at += whole
        rest = ids[at:]
        if last and len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
            rest = rest[:0]
        self.held, self.size = [rest.tobytes()], len(rest)

    def _write(self, ids: np.ndarray, room: int) -> None:
        mask = np.arange(room) < len(ids)
        ids = np.concatenate((ids, np.zeros(room - len(ids), self.dtype))) if room > len(ids) else ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()


class SequenceFile:
    """Random access to the sequences of a file. On a local or mounted path they are views of the mapped file, not copies."""

    def __init__(self, path: str):
        system, where = _file_system(path)
        self.source = pa.memory_map(where) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(where)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def _batch(self, i: int) -> np.ndarray:
        return self.reader.get_batch(i).column(0).values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        b = self._batch(i // BATCH)
        return b[i % BATCH * self.length : (i % BATCH + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        return self.reader.get_batch(i // BATCH).column(1).values.to_numpy(zero_copy_only=False)[i % BATCH * self.length : (i % BATCH + 1) * self.length]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids `start` to `start + n`, which may reach over batches."""
        whole = self.length * BATCH
        parts = []
        while n > 0:
            b = self._batch(start // whole)[start % whole :][:n]
            parts.append(b)
            start, n = start + len(b), n - len(b)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the ids of all rows of `docs` (doc_id, text) to files below `folder`; the manifest, a row (r, path, n_tokens)
    for each file in ascending order of ids.

    Order: (doc_id, hash of the text), null ids first. Each document's ids end with END; a null or empty text is END alone. Beside
    each file of sequences stands its index (doc_id, start in the file, n_tokens). Texts are dealt once, by ranges of
    ids, and a file holds a range. An empty table gives no file. Rows that repeat an id, or an id and a text, are
    documents of their own; other columns are ignored.
    """
    folder = store_folder(docs.sparkSession, folder)
    rows = keyed(docs)
    bounds, firsts = range_bounds(rows)
    if not firsts:
        return docs.sparkSession.createDataFrame([], "r long, path string, n_tokens long")
    dealt = rows.withColumn("r", range_of(bounds)).repartitionById(firsts[-1][0] + 1, "r").sortWithinPartitions("r", "doc_id", "h", F.desc("is_null"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        end = np.array([END], code.dtype).tobytes()
        now, files = None, {}
        for b in batches:
            encoded = code.encode(b.column("text").cast(pa.string()))
            for r, doc_id, is_null, ids in zip(b.column("r").to_pylist(), b.column("doc_id").to_pylist(), b.column("is_null").to_pylist(), encoded):
                if r != now:
                    now, path = r, f"{folder}/{r:08d}-{uuid.uuid4().hex}.arrow"
                    files[r] = path, SequenceWriter(path, code.dtype), []
                _, out, index = files[r]
                index.append((None if is_null else doc_id, out.total, len(ids) + 1))
                out.add(ids.tobytes() + end)
        for r, (path, out, index) in files.items():
            out.close()
            system, where = _file_system(path + ".index")
            with system.open_output_stream(where) as sink, pa.ipc.new_file(sink, INDEX) as w:
                w.write_table(pa.table([pa.array(x, pa.int64()) for x in zip(*index)], schema=INDEX))
            yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int64()), "path": [path], "n_tokens": pa.array([out.total], pa.int64())})

    return written(dealt.select("r", "doc_id", "is_null", "text").mapInArrow(write, "r long, path string, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the files of a manifest: `start` counts the ids of all
    documents before it, the checksum is of all its ids as little-endian unsigned 32-bit integers.

    Only the files' numbers of ids come to the driver, one number a file.
    """
    files = sorted((r["r"], r["path"], r["n_tokens"]) for r in manifest.collect())
    before, listed = 0, []
    for r, path, n in files:
        listed.append((r, path, before))
        before += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                held = SequenceFile(path)
                system, where = _file_system(path + ".index")
                with system.open_input_file(where) as source:
                    index = pa.ipc.open_file(source).read_all()
                crc = [zlib.crc32(held.ids(s, n).astype("<u4").tobytes()) for s, n in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist())]
                start = index["start"].combine_chunks().to_numpy() + before
                for p in pa.table({"doc_id": index["doc_id"], "start": start, "n_tokens": index["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())}).to_batches():
                    yield p

    spark = manifest.sparkSession
    table = spark.createDataFrame([(i, *f) for i, f in enumerate(listed)], "i long, r long, path string, before long")
    if files:  # a file a task
        table = table.repartitionById(len(files), F.col("i").cast("int"))
    return table.select("path", "before").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(documents(spark, sf_dir), scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest)
