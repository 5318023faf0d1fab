"""A hidden Markov language model over words, trained by Baum-Welch, beside a unigram base.

Symbols are the HEAD most frequent words and, for all others, classes by their last letters and length. A
state emits a symbol; a class then gives its word by add-one counts, which no state changes, so a text's
likelihood is the scaled forward recursion over its symbols times its rare words' shares of their classes.
Counts of words cover all training texts. Frequent words' counts go with the tasks (KNOWN rows at most); all
other words of a text are joined with the count table. Start values are the words' shares of the corpus, moved
at random for each state; each round sums expected counts of all training texts, whole, over partitions, and
rounds end when they hardly add to the likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

STATES, HEAD, CLASSES, KNOWN = 8, 1 << 15, 1 << 11, 1 << 17
#: Baum-Welch rounds at most, each over all training texts; they end once a round adds less than GAIN to a symbol's log10 likelihood.
ROUNDS, GAIN = 14, 2e-3
#: Tokens that one recursion holds, and tokens whose hashes are counted together.
TOKENS, COUNT_TOKENS = 500_000, 4_000_000
#: Texts that go on at a step from which its moves are summed by itself.
WIDE = 200
END = np.uint64(1)
PRIOR = 50.0


def held_out(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 7, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of each token, an end behind each text, and where each text begins."""
    data, offsets = common.utf8(column)
    data = words.LOWER[data]
    starts, ends, first = words.bounds(data, offsets)
    h = words.hashes(data, starts, ends)
    last = data[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    size = ends - starts
    before = np.where(size > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64) if len(ends) else last
    form = (last * 256 + before) * 4 + np.digitize(size, (4, 7, 11))
    cls = (words.mix(form.astype(np.uint64)) % np.uint64(CLASSES)).astype(np.int32)
    n = len(offsets) - 1
    at = first[1:]
    edges = first + np.arange(n + 1)
    return np.insert(h, at, END), np.insert(cls, at, 0), edges


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        h, cls = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        coded = pa.array(h.view(np.int64)).dictionary_encode()
        at = coded.indices.to_numpy()
        own = np.empty(len(coded.dictionary), np.int32)
        own[at] = cls  # one class a word
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(own), pa.array(np.bincount(at, minlength=len(own)))], names=["h", "cls", "n"])

    for batch in common.slices(batches):
        h, cls, _ = tokens_of(batch.column(0))
        held.append((h, cls))
        if sum(len(x) for x, _ in held) >= COUNT_TOKENS:
            yield flush()
    if held:
        yield flush()


@dataclass
class Vocabulary:
    """Sorted hashes of the most frequent words with their counts and symbols (-1: none of its own), and class sums."""

    key: np.ndarray
    n: np.ndarray
    symbol: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray
    total: int
    distinct: int
    head: int

    @property
    def symbols(self) -> int:
        return self.head + CLASSES


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the count table (h, cls, n): KNOWN + CLASSES + 1 rows come to the driver at most."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    # the most frequent words, by steps of 2 % of the count: about KNOWN of them at most, and no task sends others
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.02)))
    room = KNOWN
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("v")).collect(), key=lambda r: -r["s"]):
        if r["v"] > room:  # of the first counts that are too many, some words by their hash
            some = F.pmod("h", F.lit(1 << 20)) < int(0.9 * room / r["v"] * (1 << 20))
            wanted = (step > r["s"]) | ((step == r["s"]) & some)
            break
        room -= r["v"]
    else:
        wanted = F.lit(True)
    top = counts.where(wanted).toArrow()
    h, cls, n = (top.column(c).to_numpy() for c in ("h", "cls", "n"))
    order = np.lexsort((h, -n))
    h, cls, n = h[order].view(np.uint64), cls[order], n[order]
    head = min(HEAD, len(h))
    symbol = np.where(np.arange(len(h)) < head, np.arange(len(h)), -1)
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    np.subtract.at(class_n, cls[:head], n[:head])
    np.subtract.at(class_v, cls[:head], 1)
    by = np.argsort(h)
    return Vocabulary(h[by], n[by], symbol[by], class_n, class_v, int(total["n"] or 0), int(total["v"]), head)


def encoder(vocab):
    """Texts to symbols, with the frequent words' part of both scores and the rare words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        log_n = np.log10(v.n + 1.0)
        share = np.log10(v.class_n + v.class_v + 1.0)
        for batch in common.slices(batches):
            h, cls, edges = tokens_of(batch.column(3))
            at = np.minimum(np.searchsorted(v.key, h), max(len(v.key) - 1, 0))
            known = v.key[at] == h if len(v.key) else np.zeros(len(h), bool)
            symbol = np.where(known, v.symbol[at], -1) if len(v.key) else np.full(len(h), -1)
            own = symbol >= 0
            symbol = np.where(own, symbol, v.head + cls).astype(np.uint16)
            base = np.where(known, log_n[at], 0.0) if len(v.key) else np.zeros(len(h))
            inner = np.where(own, 0.0, np.where(known, base, 0.0) - share[cls])
            sums = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  each text has its end at least
            rare = np.flatnonzero(~known)
            rare_edges = np.searchsorted(rare, edges).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(edges)), pa.array(sums(known.astype(np.int64))), pa.array(sums(base)), pa.array(sums(inner)),
                    pa.array([symbol[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(rare_edges), pa.array(h[rare].view(np.int64))),
                ],
                names=["doc_id", "_row", "held_out", "n_tokens", "n_common", "base_part", "inner_part", "symbols", "rare"],
            )

    return run


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


@dataclass
class Expected:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    score: float = 0.0  # log10 likelihood of the texts
    symbols: float = 0.0

    def add(self, other: Expected) -> None:
        for name in ("start", "move", "emit", "score", "symbols"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def model(self, background: np.ndarray) -> Model:
        k = len(self.start)
        start = (self.start + 1) / (self.start.sum() + k)
        move = self.move + np.eye(k) * 5 + 0.5
        emit = self.emit + PRIOR * background[:, None]
        return Model(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, n: int, width: int) -> np.ndarray:
    """``n`` rows to write to, the same memory each time: fresh memory costs a process more than the sums that go there."""
    have = _rooms.get(name)
    if have is None or have.shape[1] != width or len(have) < n:
        _rooms.pop(name, None)
        have = _rooms[name] = np.empty((max(n, TOKENS + TOKENS // 8), width))
    return have[:n]


class Texts:
    """Symbols of some texts, the longest first, so that those still running at a step are a prefix.

    Tokens are kept step by step: those of step t are one run of ``flat``, in the order of the texts.
    """

    def __init__(self, symbols: list[np.ndarray]) -> None:
        self.order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
        self.length = np.array([len(symbols[i]) for i in self.order])
        self.live = np.searchsorted(-self.length, -np.arange(self.length[0]), side="left")
        self.step = np.concatenate([[0], np.cumsum(self.live)])
        self.text = np.arange(self.step[-1]) - np.repeat(self.step[:-1], self.live)
        self.flat = np.empty(self.step[-1], np.uint16)
        for i, k in enumerate(self.order):
            self.flat[self.step[: len(symbols[k])] + i] = symbols[k]

    def _run(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions, scaled states and scales of each token."""
        size, k = len(self.flat), len(m.start)
        emit, states, scales, one = _room("emit", size, k), _room("states", size, k), np.empty((size, 1)), np.ones((k, 1))
        np.take(m.emit, self.flat, axis=0, out=emit, mode="clip")
        edges = self.step.tolist()
        n = edges[1]
        a = np.multiply(emit[:n], m.start, out=states[:n])
        a /= np.matmul(a, one, out=scales[:n])
        for s, e in zip(edges[1:-1], edges[2:], strict=True):
            a = np.matmul(a[: e - s], m.move, out=states[s:e])
            a *= emit[s:e]
            a /= np.matmul(a, one, out=scales[s:e])
        return emit, states, scales

    def forward(self, m: Model) -> np.ndarray:
        """log10 likelihood of each text in order."""
        return np.bincount(self.text, np.log10(self._run(m)[2][:, 0]), minlength=len(self.length))

    def expect(self, m: Model) -> Expected:
        w, states, scales = self._run(m)
        score = float(np.log10(scales).sum())
        w /= scales
        k = len(m.start)
        b = _room("behind", len(w), k)
        b[:] = 1
        edges = self.step.tolist()
        back, move = np.ascontiguousarray(m.move.T), np.zeros((k, k))
        for t in range(len(edges) - 2, 0, -1):
            s, e = edges[t], edges[t + 1]
            before = slice(edges[t - 1], edges[t - 1] + e - s)
            x = w[s:e]
            x *= b[s:e]
            if e - s >= WIDE:
                move += states[before].T @ x
            np.matmul(x, back, out=b[before])
        n = edges[1]
        # the other steps, of few texts each, together
        rest = edges[max(1, int(np.searchsorted(-self.live, -WIDE, side="right")))]
        before = self.text[rest:] + np.repeat(self.step[:-2], self.live[1:])[rest - n :]
        move += states[before].T @ w[rest:]
        states *= b
        symbol = self.flat.astype(np.intp)
        emit = np.stack([np.bincount(symbol, states[:, i], minlength=len(m.emit)) for i in range(k)], axis=1)
        return Expected(states[:n].sum(axis=0), move * m.move, emit, score, float(len(self.flat)))


def grouped(symbols: list[np.ndarray], most: int = TOKENS) -> Iterator[list[int]]:
    """Indices of texts in groups of like length and about ``most`` tokens."""
    group: list[int] = []
    size = 0
    for i in sorted(range(len(symbols)), key=lambda i: -len(symbols[i])):
        group.append(i)
        size += len(symbols[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def sum_expected(symbols: list[np.ndarray], m: Model) -> Expected:
    out = Expected(*(np.zeros(x.shape) for x in (m.start, m.move, m.emit)))
    for group in grouped(symbols):
        out.add(Texts([symbols[i] for i in group]).expect(m))
    return out


def _expecter(model, states: int):
    """A row for each symbol of a task's texts, and rows -1 (start), -2 (score and symbols) and -3, -4, ... (moves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        total = Expected(np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit))
        # texts wait for others of like length, whatever batch they come with: a recursion takes as many steps as its longest text has tokens
        held: dict[int, list[np.ndarray]] = {}
        waiting: dict[int, int] = {}
        for batch in batches:
            for text in _symbols(batch.column(0)) if batch.num_rows else ():
                size = len(text).bit_length()
                held.setdefault(size, []).append(text)
                waiting[size] = waiting.get(size, 0) + len(text)
                if waiting[size] >= TOKENS:
                    waiting[size] = 0
                    total.add(Texts(held.pop(size)).expect(m))
        total.add(sum_expected([text for texts in held.values() for text in texts], m))
        seen = np.flatnonzero(total.emit.sum(axis=1))
        ids = np.concatenate([[-1, -2], -3 - np.arange(states), seen]).astype(np.int32)
        sums = np.zeros((1, states))
        sums[0, :2] = total.score, total.symbols
        values = np.concatenate([total.start[None], sums, total.move, total.emit[seen]])
        _rooms.clear()
        common.give_back()
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(values[:, i].copy()) for i in range(states))], names=["symbol", *(f"e{i}" for i in range(states))])

    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = _symbols(batch.column(1))
            out = np.zeros(len(symbols))
            for group in grouped(symbols):
                texts = Texts([symbols[i] for i in group])
                out[np.array(group)[texts.order]] = texts.forward(model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["_row", "path_score"])

    return run


def train(coded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    spark = coded.sparkSession
    background = np.full(vocab.symbols, 1.0)
    np.add.at(background, vocab.symbol[vocab.symbol >= 0], vocab.n[vocab.symbol >= 0])
    background[vocab.head :] += vocab.class_n
    background /= background.sum()
    rng = np.random.default_rng(7)
    emit = background[:, None] * rng.uniform(0.5, 1.5, (vocab.symbols, states))
    move = np.full((states, states), 0.1 / states) + np.eye(states) * 0.9
    model = Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    training = coded.where("not held_out").select("symbols")
    before = -np.inf
    for _ in range(rounds):
        at = spark.sparkContext.broadcast(model)
        schema = "symbol int, " + ", ".join(f"e{i} double" for i in range(states))
        sums = training.mapInArrow(_expecter(at, states), schema).groupBy("symbol").agg(*(F.sum(f"e{i}").alias(f"e{i}") for i in range(states)))
        rows = sums.toArrow()  # symbols + states + 2 rows at most
        ids = rows.column("symbol").to_numpy()
        values = np.stack([rows.column(f"e{i}").to_numpy() for i in range(states)], axis=1)
        e = Expected(np.zeros(states), np.zeros((states, states)), np.zeros((vocab.symbols, states)))
        e.start += values[ids == -1].sum(axis=0)
        for i in range(states):
            e.move[i] += values[ids == -3 - i].sum(axis=0)
        e.emit[ids[ids >= 0]] = values[ids >= 0]
        model = e.model(background)
        at.unpersist()
        common.release_shuffles(spark)
        score, symbols = values[ids == -2].sum(axis=0)[:2]
        now = score / max(symbols, 1.0)  # of the model before this round
        if now - before < gain:
            break
        before = now
    return model


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null text is its end alone. A null doc_id is a training text. Repeated rows are texts of their own. An
    empty table gives an empty result, and where no text is for training every word is unknown; other columns
    are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    doc = common.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("held_out", held_out(F.col("doc_id")))
    counts = doc.where("not held_out").select("text").mapInArrow(_counts, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))
    counts = common.cut(counts, "words")
    common.release_shuffles(spark)
    vocab = vocabulary(counts)
    at = spark.sparkContext.broadcast(vocab)  # KNOWN rows at most
    schema = "doc_id long, _row long, held_out boolean, n_tokens long, n_common long, base_part double, inner_part double, symbols binary, rare array<long>"
    coded = common.cut(doc.select("doc_id", "_row", "held_out", "text").mapInArrow(encoder(at), schema), "coded")
    rare = coded.select("_row", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h")
    rare = rare.groupBy("_row").agg(F.count("*").alias("n_rare"), F.sum(F.log10(F.col("n") + 1.0)).alias("rare_part"))
    rare = common.cut(rare, "rare")
    common.release_shuffles(spark)
    model = spark.sparkContext.broadcast(train(coded, vocab, states, rounds))
    paths = coded.select("_row", "symbols").mapInArrow(_scorer(model), "_row long, path_score double")
    share = float(np.log10(vocab.total + vocab.distinct + 1))
    out = coded.drop("symbols", "rare").join(paths, "_row").join(rare, "_row", "left")
    extra = F.coalesce("rare_part", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + extra - F.col("n_tokens") * share).alias("base_score"), (F.col("path_score") + F.col("inner_part") + extra).alias("score"),
    )


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
