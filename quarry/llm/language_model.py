"""Language-model scores of whole documents: a gated recurrent network over exact corpus counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import by_size, documents, remainder, trimmed, written

#: Most frequent tokens that the network knows; the others are one symbol to it, told apart by their counts.
KNOWN = 4095
#: Most frequent tokens, at most, whose counts every executor holds; the counts of the others are joined.
HEAD = 200_000
#: Units, classes of the output, lanes that run side by side, and steps between which the state is carried on.
UNITS, CLASSES, LANES, WINDOW = 24, 64, 256, 32
#: Tokens up to which the network learns from all training documents: any number. Only a caller that sets a bound gets, beyond it, a share of LEARNED at least.
ALL, LEARNED = math.inf, 0.2
#: Training tokens of a replica of the network, about; rounds after which the replicas are averaged; lanes, at most, of a replica; learning rate.
SHARD, ROUNDS, TRAINING_LANES, RATE = 2_000_000, 8, 192, 0.02
#: Rows whose logits are computed together, so that they stay in the cache.
BLOCK = 1024
#: Weights of a network that are averaged together.
PIECE = 16_384
#: Tokens that a task scores together, about, and bytes of text that are cut in tokens together; a longer text is taken by itself.
TOGETHER, BYTES = 1_000_000, 2_000_000
#: Bytes of words and counts that a task holds before it sums them up, about.
COUNTED = 32_000_000
#: Word that ends each document; no text has it, as it is white space.
END = " "
FOLD = 7


def coded(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """(words, bounds, token): the different tokens of some texts; text i's tokens are words[token[bounds[i]:bounds[i + 1]]].

    A text's tokens are its words with A-Z in lower case, then END. Null has END alone. Takes some ten times the texts' bytes.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.values.cast(pa.binary()).dictionary_encode()
    words, token = found.dictionary, found.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    blank = pc.index(words, pa.scalar(b"", pa.binary())).as_py()
    if blank >= 0:  # stands before a leading blank and after the last
        live = token != blank
        token, text = token[live], text[live]
    ends = np.searchsorted(text, np.arange(len(texts)), side="right")
    words = pa.concat_arrays([words, pa.array([END.encode()], pa.binary())])
    return words, np.append(0, ends + np.arange(1, len(texts) + 1)), np.insert(token, ends, len(words) - 1)


def as_list(words: pa.BinaryArray) -> list[bytes]:
    """The words by their buffers, as `to_pylist` takes far longer. None of them is null."""
    _, offsets, data = words.buffers()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in pairwise(np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).tolist())]


def tokens(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """`coded`, the words as a list."""
    words, bounds, token = coded(texts)
    return as_list(words), bounds, token


class Network:
    """A gated recurrent unit with a class-factored softmax.

    P(symbol | past) = P(class | state) * P(symbol | class, state). Symbols are dealt to CLASSES by frequency, about as
    many to each. The input's part of the gates is a table row for each symbol, so a step costs one product of the
    states with the recurrent weights.
    """

    def __init__(self, symbols: int, units: int = UNITS, classes: int = CLASSES, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.symbols, self.units = symbols, units
        self.per = -(-symbols // classes)
        self.classes = -(-symbols // self.per)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        # inputs (a row more for a document's start), recurrent weights, class weights and biases, symbol weights and biases
        self.weights = {
            "x": small(symbols + 1, 3 * units), "u": (rng.normal(0, 1, (units, 3 * units)) / math.sqrt(units)).astype(np.float32),
            "c": small(units, self.classes), "cb": np.zeros(self.classes, np.float32),
            "s": small(self.classes, units, self.per), "sb": np.zeros((self.classes, self.per), np.float32),
        }
        # places of the last class that no symbol has
        self.unused = self.classes * self.per - symbols

    def start_biases(self, counts: np.ndarray) -> None:
        """Sets the output's biases to the symbols' frequencies."""
        p = np.full(self.classes * self.per, 1e-9)
        p[: self.symbols] = (counts + 1) / (counts + 1).sum()
        p = p.reshape(self.classes, self.per)
        self.weights["cb"] = np.log(p.sum(1)).astype(np.float32)
        self.weights["sb"] = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def _tables(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Recurrent weights (3, units, units) and the inputs' table `rows` (3, rows, units), halved for the two gates.

        Gates are an update and a reset gate: 1 / (1 + exp(-v)) as (tanh(v / 2) + 1) / 2, with the halves in the weights.
        """
        n, w = self.units, self.weights
        half = np.array([0.5, 0.5, 1.0], w["u"].dtype)[:, None, None]
        return tuple(np.multiply(v.reshape(-1, 3, n).transpose(1, 0, 2), half, order="C") for v in (w["u"], w["x"][rows]))

    def _run(self, h: np.ndarray, inputs: np.ndarray, starts: np.ndarray, tables: tuple[np.ndarray, np.ndarray], keep: bool = True) -> tuple[np.ndarray, ...]:
        """(states before, states after, gates and recurrent parts of the candidates (steps, 3, lanes, units), candidates) of
        a window of rows `inputs` of the table from states `h`; a lane's state is cleared where `starts`. Unless `keep`, all
        but the states after are those of the last step."""
        u, table = tables
        (steps, lanes), n, held = inputs.shape, self.units, len(inputs) if keep else 1
        before, c, after = (np.empty((k, lanes, n), u.dtype) for k in (held, held, steps))
        parts, own = np.empty((held, 3, lanes, n), u.dtype), np.empty((3, lanes, n), u.dtype)
        one_half, clear = u.dtype.type(0.5), starts.any(1).tolist()
        for t in range(steps):
            k = t if keep else 0
            old, g, ct = before[k], parts[k], c[k]
            np.copyto(old, h)
            if clear[t]:
                old[starts[t]] = 0
            np.matmul(old, u, out=g)
            table.take(inputs[t], 1, out=own, mode="clip")
            zr = g[:2]
            zr += own[:2]
            np.tanh(zr, out=zr)
            zr *= one_half
            zr += one_half
            np.multiply(g[1], g[2], out=ct)
            ct += own[2]
            np.tanh(ct, out=ct)
            h = np.subtract(old, ct, out=after[t])
            h *= g[0]
            h += ct
        return before, after, parts, c

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, update gate, reset gate, candidate, recurrent part of the candidate) of one step."""
        _, after, parts, c = self._run(h, x[None], x[None] == self.symbols, self._tables())
        return after[0], parts[0, 0], parts[0, 1], c[0], parts[0, 2]

    def _output(self, most: float) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
        """Class weights and each class's symbol weights, both with the biases as a last row, and what the classes' logits and
        each class's symbols' logits can't exceed, whatever the sign, if no state exceeds `most`."""
        w = self.weights
        c, s = np.concatenate((w["c"], w["cb"][None])), np.concatenate((w["s"], w["sb"][:, None]), 1)
        reach = np.append(np.full(self.units, most), 1).astype(c.dtype)
        return c, s, float((reach @ np.abs(c)).max()), (reach @ np.abs(s)).max(1).tolist()

    def _by_class(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order by class, classes, places, states with a 1 for the biases), the last three in that order."""
        cls = target // self.per
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cls = cls.take(order)
        place = target.take(order) - cls * self.per
        states = np.empty((len(order), self.units + 1), h.dtype)
        states[:, :-1], states[:, -1] = h.take(order, 0), 1
        return order, cls, place, states

    def _runs(self, cls: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(begin, end, [(class, begin, end)]) of blocks of rows in order of class, so small that their logits stay in the cache."""
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        for i in range(0, len(cls), BLOCK):
            j = min(i + BLOCK, len(cls))
            yield i, j, [(k, max(i, cuts[k]), min(j, cuts[k + 1])) for k in range(cls[i], cls[j - 1] + 1) if cuts[k] < cuts[k + 1]]

    @staticmethod
    def _logits(h: np.ndarray, w: np.ndarray, bound: float, out: np.ndarray) -> None:
        """Logits that can be raised to powers of e: less the row's largest if they may leave the range of float32."""
        np.matmul(h, w, out=out)
        if bound > 60:
            out -= out.max(-1, keepdims=True)

    def log_probabilities(self, h: np.ndarray, target: np.ndarray, output: tuple | None = None) -> np.ndarray:
        """Natural logarithm of P(target | state) for each row; rows of one class are computed together."""
        c, s, bound, bounds = output or self._output(max(1.0, float(np.abs(h).max(initial=0))))
        order, cls, place, states = self._by_class(h, target)
        top, low = (np.empty((min(BLOCK, len(order)), k), h.dtype) for k in (self.classes, self.per))
        ones, rows = np.ones(max(self.classes, self.per), h.dtype), np.arange(len(top))
        found = np.empty(len(order), h.dtype)
        for i, j, runs in self._runs(cls):
            at, x, y = rows[: j - i], top[: j - i], low[: j - i]
            self._logits(states[i:j], c, bound, x)
            for k, begin, end in runs:
                self._logits(states[begin:end], s[k], bounds[k], y[begin - i : end - i])
            true = x[at, cls[i:j]] + y[at, place[i:j]]
            # sums by products are the faster ones
            found[i:j] = true - np.log(np.exp(x, out=x) @ ones[: self.classes]) - np.log(np.exp(y, out=y) @ ones[: self.per])
        out = np.empty_like(found)
        out[order] = found
        return out

    def vector(self) -> np.ndarray:
        """All weights, end to end."""
        return np.concatenate([w.reshape(-1) for w in self.weights.values()])

    def take(self, vector: np.ndarray) -> None:
        """Sets all weights from `vector`."""
        cuts = np.cumsum([w.size for w in self.weights.values()])[:-1]
        self.weights = {k: v.reshape(w.shape).astype(np.float32) for (k, w), v in zip(self.weights.items(), np.split(vector, cuts))}

    def train(self, documents: list[np.ndarray], lanes: int = TRAINING_LANES, window: int = WINDOW, rate: float = RATE, begin: float = 0.0, end: float = 1.0) -> None:
        """One pass over documents laid end to end by backpropagation truncated to `window` steps.

        The state is carried on from window to window and cleared at each document's start, as in scoring. `begin` and
        `end` say which part of the whole training this is: the learning rate falls with it. Few tokens take fewer lanes.
        """
        total = sum(map(len, documents))
        lanes = max(1, min(lanes, total // (8 * window)))
        if not total:
            return
        # each symbol's input is the one before it, or the start row; what doesn't fill all lanes is not lost but cut off the last window
        y = np.concatenate(documents)
        x = np.concatenate([np.concatenate(([self.symbols], d[:-1])) for d in documents])
        per = -(-total // lanes)
        y, x = (np.append(v, v[: per * lanes - total]).reshape(lanes, per).T for v in (y, x))
        h = np.zeros((lanes, self.units), np.float32)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t, at in enumerate(range(0, per, window), 1):
            rows, grads, h = self._sparse_gradients(h, x[at : at + window], y[at : at + window])
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
            done = begin + (end - begin) * at / per
            lr = rate * min(1.0, 0.1 + 0.9 * (1 - done)) * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for k, g in grads.items():
                # inputs that a window doesn't have keep their weights and moments
                f, v = (m[k].take(rows, 0) if k == "x" else m[k] for m in (first, second))
                g *= np.float32(0.1 * clip)
                f *= np.float32(0.9)
                f += g
                np.multiply(g, g, out=g)
                g *= np.float32(0.1)  # 0.001 of the square, of which g has 0.01
                v *= np.float32(0.999)
                v += g
                np.sqrt(v, out=g)
                g += np.float32(1e-6)
                np.divide(f, g, out=g)
                g *= np.float32(lr)
                if k == "x":
                    first[k][rows], second[k][rows] = f, v
                    self.weights[k][rows] -= g
                else:
                    self.weights[k] -= g

    def _gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(the gradients of the mean loss by all weights, the last states) of a window."""
        rows, g, h = self._sparse_gradients(h, x, y)
        dense = np.zeros_like(self.weights["x"])
        dense[rows] = g["x"]
        return g | {"x": dense}, h

    def _sparse_gradients(self, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """(inputs that the window has, gradients, the inputs' for those alone, the last states) of a window."""
        w, n = self.weights, self.units
        steps, lanes = x.shape
        by_input = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")
        inputs = x.reshape(-1).take(by_input)
        cuts = np.flatnonzero(np.append(True, inputs[1:] != inputs[:-1]))
        rows, sizes = inputs[cuts], np.diff(np.append(cuts, len(inputs)))
        of = np.empty(len(inputs), np.intp)
        of[by_input] = np.repeat(np.arange(len(rows)), sizes)
        starts = x == self.symbols
        before, after, parts, c = self._run(h, of.reshape(x.shape), starts, self._tables(rows))
        z, r, own = (parts[:, k] for k in range(3))
        kind = after.dtype
        g, dh = self._output_gradients(after.reshape(-1, n), y.reshape(-1))
        dh = dh.reshape(steps, lanes, n)
        # by the gates' parts, by the recurrent part of the candidates and by their inputs' part
        da, back = np.empty((steps, 4, lanes, n), kind), np.ascontiguousarray(w["u"].reshape(n, 3, n).transpose(1, 2, 0))
        carried, d, spread, one = np.zeros((lanes, n), kind), np.empty((lanes, n), kind), np.empty((3, lanes, n), kind), kind.type(1)
        a, b = np.empty((lanes, n), kind), np.empty((lanes, n), kind)
        clear = starts.any(1).tolist()
        for t in range(steps - 1, -1, -1):
            zt, rt, ct, (dz, dr, dc, di) = z[t], r[t], c[t], da[t]
            np.add(dh[t], carried, out=d)
            np.multiply(d, zt, out=carried)
            # d (1 - z), on the way to the candidate and, by (before - c) z, to the update gate
            np.subtract(d, carried, out=a)
            np.subtract(before[t], ct, out=b)
            b *= zt
            np.multiply(a, b, out=dz)
            np.multiply(ct, ct, out=b)
            np.subtract(one, b, out=b)
            np.multiply(a, b, out=di)
            np.multiply(di, rt, out=dc)
            # di own r (1 - r)
            np.subtract(di, dc, out=dr)
            dr *= own[t]
            dr *= rt
            np.matmul(da[t, :3], back, out=spread)
            for part in spread:
                carried += part
            if clear[t]:
                carried[starts[t]] = 0
        g["u"] = np.matmul(before.transpose(0, 2, 1)[:, None], da[:, :3]).sum(0).transpose(1, 0, 2).reshape(n, 3 * n)
        # rows of the gates' and of the candidates' inputs, in the order of the inputs
        at = by_input + by_input // lanes * (3 * lanes)
        sums = da.reshape(-1, n).take((at[:, None] + np.array([0, lanes, 3 * lanes])).reshape(-1), 0).reshape(-1, 3 * n)
        g["x"], ones = np.empty((len(rows), 3 * n), kind), np.ones(len(inputs), kind)
        # frequent inputs' are summed by products, the others' together: the first of each, the second of those that have one, and so on
        for k in np.flatnonzero(sizes > 16).tolist():
            i, j = cuts[k], cuts[k] + sizes[k]
            np.matmul(ones[: j - i], sums[i:j], out=g["x"][k])
        few = np.flatnonzero(sizes <= 16)
        few = few[np.argsort(-sizes[few], kind="stable")]
        at, left = cuts[few], -sizes[few]
        total = sums.take(at, 0)
        for k in range(1, -int(left.min(initial=0))):
            m = int(np.searchsorted(left, -k))
            total[:m] += sums.take(at[:m] + k, 0)
        g["x"][few] = total
        return rows, {k: g[k] for k in w}, after[-1]

    def _output_gradients(self, h: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the mean loss by the output's weights, by the states `h`)."""
        n, kind = self.units, h.dtype
        c, s, bound, bounds = self._output(max(1.0, float(np.abs(h).max(initial=0))))
        order, cls, place, states = self._by_class(h, target)
        top, low = (np.empty((min(BLOCK, len(order)), k), kind) for k in (self.classes, self.per))
        ones, rows, scale = np.ones(max(self.classes, self.per), kind), np.arange(len(top)), kind.type(1 / len(target))
        gc, gs, ds, more = np.zeros_like(c), np.zeros_like(s), np.empty((len(order), n), kind), np.empty((len(top), n), kind)
        back, backs = np.ascontiguousarray(c[:-1].T), s[:, :-1].transpose(0, 2, 1)

        def errors(logits: np.ndarray, at: np.ndarray) -> None:
            """The loss's gradient by the logits, in their place."""
            np.exp(logits, out=logits)
            logits *= (scale / (logits @ ones[: logits.shape[1]]))[:, None]
            logits[rows[: len(logits)], at] -= scale

        for i, j, runs in self._runs(cls):
            mine, x, y, m = states[i:j], top[: j - i], low[: j - i], more[: j - i]
            self._logits(mine, c, bound, x)
            errors(x, cls[i:j])
            gc += mine.T @ x
            np.matmul(x, back, out=ds[i:j])
            for k, begin, end in runs:
                self._logits(states[begin:end], s[k], bounds[k], y[begin - i : end - i])
            errors(y, place[i:j])
            for k, begin, end in runs:
                d = y[begin - i : end - i]
                gs[k] += states[begin:end].T @ d
                np.matmul(d, backs[k], out=m[begin - i : end - i])
            ds[i:j] += m
        dh = np.empty_like(ds)
        dh[order] = ds
        return {"c": gc[:-1], "cb": gc[-1], "s": gs[:, :-1], "sb": gs[:, -1]}, dh

    def score(self, texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each symbol sequence as a whole, from the state at a document's start.

        Sequences of about one length run side by side, `lanes` at a time, longest first; those that have ended leave
        the lanes. The states go on from window to window, however long a document is, and only a window's targets,
        states and probabilities are held at a time.
        """
        out = np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i))
        tables, output = self._tables(), self._output(1.0)  # no state that began at 0 exceeds 1
        for group in batched(order, lanes):
            lengths = np.array([len(texts[i]) for i in group])
            whose = np.array(group)
            h = np.zeros((len(group), self.units), np.float32)
            last = np.full(len(group), self.symbols, np.int32)
            for at in range(0, int(lengths.max(initial=0)), window):
                live = int((lengths > at).sum())  # the longest come first
                h, last = h[:live], last[:live]
                target = np.zeros((min(window, int(lengths[0]) - at), live), np.int32)
                for k, i in enumerate(group[:live]):
                    part = texts[i][at : at + window]
                    target[: len(part), k] = part
                inputs = np.concatenate((last[None], target[:-1]))
                after = self._run(h, inputs, inputs == self.symbols, tables, keep=False)[1]
                h, last = after[-1], target[-1]
                true = np.arange(at, at + len(target))[:, None] < lengths[None, :live]
                logs = self.log_probabilities(after[true], target[true], output)
                out += np.bincount(np.broadcast_to(whose[:live], true.shape)[true], logs, len(texts))
        return out


class Model:
    """The head's counts, the network, and what the probability of a token that the network doesn't know rests on.

    Such a token has P(unknown | past) * (c + 1) / (tail tokens + tail types + 1): each token of the corpus that isn't
    among the KNOWN has its count and one, and a token never seen has one; so the probabilities of all tokens add up to 1.
    """

    def __init__(self, head: list[tuple[bytes, int]], total: int, types: int):
        self.total, self.types = total, types
        self.counts = dict(head)
        self.known = {w: i + 1 for i, (w, _) in enumerate(head[:KNOWN])}
        tail = total - sum(c for _, c in head[:KNOWN])
        self.tail_base = tail + (types - len(self.known)) + 1
        self.network = Network(len(self.known) + 1)
        self.network.start_biases(np.array([tail, *(c for _, c in head[:KNOWN])], np.float64))

    def symbols(self, words: list[bytes]) -> np.ndarray:
        get = self.known.get
        return np.array([get(w, 0) for w in words], np.int32)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts; a word comes once for every COUNTED / 2 bytes of different words and counts, about."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

    for b in batches:
        for part in by_size(b.column(0), BYTES):
            words, _, token = coded(part)
            n = np.bincount(token, minlength=len(words))
            t = pa.table({"word": words, "n": pa.array(n, pa.int64())})
            held.append(t.filter(pa.array(n > 0)))
            if sum(t.nbytes for t in held) > COUNTED:
                held = [summed()]
                if held[0].nbytes > COUNTED / 2:
                    yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


def _least_frequent(counts: DataFrame) -> int:
    """The frequency from which at most HEAD tokens are at least so frequent, on a scale of sixteenths of powers of two.

    A histogram of the frequencies gives it; taking the most frequent by sorting would bring HEAD rows of every
    partition to the driver.
    """
    step = F.floor(F.log2("n") * 16).alias("step")
    rows, least = 0, None
    for r in sorted(counts.groupBy(step).agg(F.count("*").alias("rows"), F.min("n").alias("n")).collect(), reverse=True):
        rows += r["rows"]
        if rows > HEAD:
            break
        least = r["n"]
    return 2**62 if least is None else least


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """(model, counts): counts (word binary, n) of all tokens of the training fold of `docs` (doc_id, text).

    All training documents are counted, and the network learns from all of them (`train`). To the driver come the most frequent
    tokens, HEAD at most, two sums and the network.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.where(remainder(F.col("doc_id"), FOLD) != 2)
    counts = written(own.select("text").mapInArrow(lambda it: trimmed(_count_words(it)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    head = sorted(((bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= _least_frequent(counts)).collect()), key=lambda x: (-x[1], x[0]))
    model = Model(head, total, types)
    if total:
        train(model, own)
    return model, counts


def train(model: Model, docs: DataFrame) -> None:
    """Trains the model's network on all documents of `docs` (doc_id, text), however many; one that occurs twice is learned twice.

    A hash deals the documents to shards of about SHARD tokens and to ROUNDS rounds. In a round a replica of the network
    learns from each shard's documents of that round, on the executors; then the network takes the replicas' average
    by numbers of tokens. So the time goes down with more executors. To the driver comes one network a round. A lost executor costs its replicas' part of a round.
    """
    spark = docs.sparkSession
    share = max(LEARNED, min(1.0, ALL / model.total))
    shards = max(1, math.ceil(model.total * share / SHARD))
    known = spark.sparkContext.broadcast(model.known)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, get = 0, known.value.get
            for part in by_size(b.column(0), BYTES):
                words, bounds, token = tokens(part)
                ids = np.array([get(w, 0) for w in words], "<u2")[token].tobytes()
                cuts = (bounds * 2).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary()), b.column(1).slice(start, len(part))], names=["ids", "h"])
                start += len(part)

    # by the text as well, as ids may be missing or repeated
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.pmod(F.hash("h"), F.lit(2**30)) < math.ceil(share * 2**30)).mapInArrow(encoded, "ids binary, h long")
    rows = rows.select("ids", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("h"), F.lit(ROUNDS)).cast("int").alias("round"))
    rows = written(rows, "encoded")
    for i in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model.network)

        def replicas(batches: Iterator[pa.RecordBatch], i: int = i, shared=shared) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}
            for b in batches:
                for ids, h, shard in zip(*(c.to_pylist() for c in b.columns)):
                    held.setdefault(shard, []).append((h, ids))
            for shard in sorted(held):
                mine = held.pop(shard)
                replica = Network(shared.value.symbols)
                replica.weights = {k: v.copy() for k, v in shared.value.weights.items()}
                parts = [np.frombuffer(ids, "<u2").astype(np.int32) for _, ids in sorted(mine)]
                replica.train(parts, begin=i / ROUNDS, end=(i + 1) / ROUNDS)
                n = float(sum(map(len, parts)))
                blocks = [replica.vector()[at : at + PIECE] for at in range(0, replica.vector().size, PIECE)]
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "shard": pa.array([shard] * len(blocks), pa.int32()), "n": [n] * len(blocks), "w": pa.array([x.astype("<f4").tobytes() for x in blocks], pa.binary())})

        def averaged(t: pa.Table) -> pa.Table:
            n = t["n"].to_numpy()
            total = sum(np.frombuffer(w, "<f4") * (k / n.sum()) for k, w in zip(n.tolist(), t["w"].to_pylist()))
            return pa.table({"block": t["block"].slice(0, 1), "n": pa.array([float(n.sum())]), "w": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        here = rows.where(F.col("round") == i).select("ids", "h", "shard").repartitionById(shards, "shard")
        parts = here.mapInArrow(lambda it, f=replicas: trimmed(f(it)), "block int, shard int, n double, w binary")
        # many replicas are averaged in two steps
        some = parts.groupBy("block", F.floor(F.col("shard") / 256).alias("of")).applyInArrow(averaged, "block int, n double, w binary")
        found = sorted((r["block"], r["w"]) for r in some.groupBy("block").applyInArrow(averaged, "block int, n double, w binary").collect())
        if found:
            model.network.take(np.concatenate([np.frombuffer(w, "<f4") for _, w in found]))


def score_rows(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one unigram score, score the model's, both base-10 logarithms of the probability of the
    whole text and its end. Null and empty texts are the end alone. Without training documents (an empty table, or
    one fold) counts are 0 and each token's probability rests on add-one alone. Rows that repeat an id are scored
    each.

    A pass over the texts scores what the HEAD counts settle and emits the rest as (row, token) pairs, one for each
    different token of a document; these meet the counts by a join on the token, in which no token is frequent.
    """
    model, counts = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tail = model.types > len(model.counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rank = {w: i for i, w in enumerate(m.counts)}.get
        # by rank, and last for a token that the head doesn't hold; the head begins with the known tokens, in the order of their symbols
        logs = np.append(np.log10(np.array(list(m.counts.values()), np.float64) + 1), np.nan)
        symbols = np.zeros(len(logs), np.int32)
        symbols[: len(m.known)] = np.arange(1, len(m.known) + 1)
        held: list[pa.Table] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            network = pa.array(m.network.score(ids) / math.log(10))
            yield from pa.concat_tables(held).append_column("network", network).combine_chunks().to_batches()

        for b in batches:
            start = 0
            for part in by_size(b.column(1), BYTES):
                words, bounds, token = coded(part)
                n, text = len(part), np.repeat(np.arange(len(part)), np.diff(bounds))
                ranks = np.array([rank(w, -1) for w in as_list(words)])
                log, symbol = logs[ranks][token], symbols[ranks][token]
                met, unknown = ~np.isnan(log), symbol == 0
                # the tokens that the head doesn't hold, each once for a text
                rest = np.flatnonzero(~met) if tail else np.zeros(0, np.int64)
                pairs, times = np.unique(text[rest] * len(words) + token[rest], return_counts=True)
                of, rare = np.divmod(pairs, len(words))
                cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
                sums = lambda of, by=None: pa.array(np.bincount(text[of], None if by is None else by[of], n), pa.int64() if by is None else pa.float64())  # noqa: B023, E731
                held.append(pa.table({
                    "doc_id": b.column(0).slice(start, n), "n_tokens": np.diff(bounds), "n_known": sums(met), "base": sums(met, log), "n_tail": sums(unknown), "tail_base": sums(met & unknown, log),
                    "words": pa.ListArray.from_arrays(cuts, words.take(pa.array(rare))), "times": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                }))
                ids += [symbol[i:j] for i, j in pairwise(bounds.tolist())]
                start += n
                size += len(token)
                if size > TOGETHER:
                    yield from flush()
                    held.clear()
                    ids.clear()
                    size = 0
        if held:
            yield from flush()

    schema = "doc_id long, n_tokens long, n_known long, base double, n_tail long, tail_base double, words array<binary>, times array<int>, network double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = written(texts.mapInArrow(lambda it: trimmed(score(it)), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    if tail:
        pairs = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", F.col("p.words").alias("w"), F.col("p.times").alias("times"))
        met = pairs.join(counts.hint("merge"), F.col("w") == F.col("word"))
        sums = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
        scored = scored.drop("words", "times").join(sums, "row", "left")
    else:
        scored = scored.withColumns({"more_known": F.lit(0), "more": F.lit(0.0)})
    more = F.coalesce("more", F.lit(0.0))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), FOLD) == 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(math.log10(model.total + model.types + 1))).alias("base_score"),
        (F.col("network") + F.col("tail_base") + more - F.col("n_tail") * F.lit(math.log10(model.tail_base))).alias("score"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(documents(spark, sf_dir))
