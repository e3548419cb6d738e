"""Scoring texts by a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ticketmill.llm.common import materialise, prepare

# The end of a text as a token; no word contains white space.
END = b"\n"
# Characters of text that share a dictionary, and that are scored together.
DICTIONARY_CHARS, SCORE_CHARS = 16_000_000, 16_000_000
# Slots of the softmax (classes times words of a class), units, steps of
# truncated backpropagation, texts per update.
CLASSES, WIDTH, UNITS, STEPS, LANES = 32, 32, 16, 16, 128
SLOTS = CLASSES * WIDTH
# Tokens of a text that training takes as one stretch; texts side by side and
# states that wait for the output layer when texts are scored.
STRETCH, SIDE, SETTLE = 512, 512, 8_192
UNKNOWN_ID, END_ID, FIRST_WORD = 0, 1, 2
# Rounds of training; each takes one in ROUND_SHARE of the training texts, so
# together they take every training text once.
ROUNDS, ROUND_SHARE, RATE = 4, 4, 0.08
EMPTY_BIAS = -40.0
SHAPES = {
    "inputs": (SLOTS, 3 * UNITS), "gates": (UNITS, 2 * UNITS), "state": (UNITS, UNITS),
    "class_w": (UNITS, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, UNITS, WIDTH), "word_b": (CLASSES, WIDTH),
}
Weights = dict[str, np.ndarray]


def tokens(text: str | None) -> list[bytes]:
    """Words with ASCII letters lower-cased, then the end."""
    return [*(text or "").encode().lower().split(), END]


# --- the network -----------------------------------------------------------------
def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in SHAPES])


def unflat(values: np.ndarray) -> Weights:
    w, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        w[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return w


def initial(counts: np.ndarray) -> Weights:
    """Small fixed pseudo-random weights; the biases give the words their share in the counts."""
    rng = np.random.default_rng(7)
    w = {name: rng.normal(0, 0.1, shape).astype(np.float32) for name, shape in SHAPES.items()}
    table = np.zeros(SLOTS)
    table[: len(counts)] = np.maximum(counts, 0.5)
    table = table.reshape(CLASSES, WIDTH)
    with np.errstate(divide="ignore"):
        w["class_b"] = np.maximum(np.log(table.sum(axis=1) / table.sum()), EMPTY_BIAS).astype(np.float32)
        w["word_b"] = np.maximum(np.log(table / max(table.max(), 1)), EMPTY_BIAS).astype(np.float32)
    return w


def forward(w: Weights, previous: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """States after each step for inputs (steps, lanes); ``keep`` gets what backpropagation needs, one array for all steps."""
    # a sigmoid is half of one plus the tanh of half its argument
    every, gates = (w["inputs"][:, : 2 * UNITS] * 0.5)[previous], w["gates"] * 0.5
    new = w["inputs"][:, 2 * UNITS :][previous]
    states, held = np.empty(new.shape, new.dtype), np.empty(new.shape, new.dtype)
    first = h
    for t in range(len(previous)):
        gate, n = every[t], new[t]
        gate += h @ gates
        np.tanh(gate, out=gate)
        gate += 1
        gate *= 0.5
        np.multiply(gate[:, :UNITS], h, out=held[t])
        n += held[t] @ w["state"]
        np.tanh(n, out=n)
        step = np.subtract(n, h, out=states[t])
        step *= gate[:, UNITS:]
        step += h
        h = step
    if keep is not None:
        keep |= {"gate": every, "held": held, "new": new, "before": np.concatenate([first[None], states[:-1]])}
    return states


def halved(w: Weights) -> tuple[np.ndarray, ...]:
    """Weights for ``advance``: a sigmoid is half of one plus the tanh of half its argument."""
    inputs = w["inputs"].copy()
    inputs[:, : 2 * UNITS] *= 0.5
    return inputs, w["gates"] * 0.5, w["state"] * 0.5


def advance(half: tuple[np.ndarray, ...], previous: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The states of ``forward``, with fewer passes over the arrays."""
    inputs, gates, state = half
    x = inputs[previous]
    states = np.empty((len(previous), *h.shape), np.float32)
    for t in range(len(previous)):
        gate = h @ gates
        gate += x[t, :, : 2 * UNITS]
        np.tanh(gate, out=gate)
        gate += 1
        new = (gate[:, :UNITS] * h) @ state
        new += x[t, :, 2 * UNITS :]
        np.tanh(new, out=new)
        new -= h
        new *= gate[:, UNITS:]
        new *= 0.5
        h = np.add(h, new, out=states[t])
    return states


def _surplus(z: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """``scale`` times the gradient of minus the log-softmax at one column per row: the shares less one there."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (scale / (z @ np.ones(z.shape[1], z.dtype)))[:, None]
    z[np.arange(len(z)), at] -= scale
    return z


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that puts targets of one class side by side, and the stretch of each class in it."""
    of = (target // WIDTH).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]


def _within(w: Weights, states: np.ndarray, classes: list[tuple[int, slice]]) -> np.ndarray:
    """The words of each state's class, before the softmax; the states are in the order of their classes."""
    z = np.empty((len(states), WIDTH), states.dtype)
    for c, own in classes:
        np.matmul(states[own], w["word_w"][c], out=z[own])
        z[own] += w["word_b"][c]
    return z


def log_probability(w: Weights, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithm: the class of each target, then the word within its class."""
    z = states @ w["class_w"]
    z += w["class_b"]
    out = _picked(z, target // WIDTH)
    order, classes = _by_class(target)
    out[order] += _picked(_within(w, states[order], classes), target[order] % WIDTH)
    return out


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of ``z`` at one column per row; states lie in (-1, 1), so no exponent is large."""
    chosen = z[np.arange(len(z)), at]
    np.exp(z, out=z)
    return chosen - np.log(z @ np.ones(z.shape[1], z.dtype))


def gradients(w: Weights, previous: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the mean negative log-probability over one window, and the last state."""
    kept: dict = {}
    states = forward(w, previous, h, kept)
    g = {}
    on = np.flatnonzero(mask.ravel())
    s, goal = states.reshape(-1, UNITS)[on], target.ravel()[on]
    scale = np.float32(1 / max(len(on), 1))
    order, classes = _by_class(goal)
    on, s, goal = on[order], s[order], goal[order]
    z = s @ w["class_w"]
    z += w["class_b"]
    dz = _surplus(z, goal // WIDTH, scale)
    g["class_w"], g["class_b"] = s.T @ dz, np.ones(len(dz), dz.dtype) @ dz
    ds = dz @ w["class_w"].T
    g["word_w"], g["word_b"] = np.zeros(SHAPES["word_w"], dz.dtype), np.zeros(SHAPES["word_b"], dz.dtype)
    inner = _surplus(_within(w, s, classes), goal % WIDTH, scale)
    ones = np.ones(len(inner), inner.dtype)
    for c, own in classes:
        mine = inner[own]
        np.matmul(s[own].T, mine, out=g["word_w"][c])
        np.matmul(ones[own], mine, out=g["word_b"][c])
        ds[own] += mine @ w["word_w"][c].T
    d_states = np.zeros((states.shape[0] * states.shape[1], UNITS), ds.dtype)
    d_states[on] = ds
    d_states = d_states.reshape(states.shape)
    before, new, held, gate = kept["before"], kept["new"], kept["held"], kept["gate"]
    reset, update = gate[..., :UNITS], gate[..., UNITS:]
    # what a state's gradient is multiplied by on its way to the candidate, the two gates and the state before
    rest = 1 - update
    to_new = (1 - new * new) * update
    to_gate = gate * (1 - gate)
    to_gate[..., :UNITS] *= before
    to_gate[..., UNITS:] *= new - before
    back_state, back_gates = np.ascontiguousarray(w["state"].T), np.ascontiguousarray(w["gates"].T)
    d_gates, d_news = np.empty_like(gate), np.empty_like(new)
    dh = np.zeros_like(states[0])
    for t in range(len(previous) - 1, -1, -1):
        dh += d_states[t]
        d_gate = d_gates[t]
        d_held = np.multiply(dh, to_new[t], out=d_news[t]) @ back_state
        np.multiply(d_held, to_gate[t, :, :UNITS], out=d_gate[:, :UNITS])
        np.multiply(dh, to_gate[t, :, UNITS:], out=d_gate[:, UNITS:])
        dh *= rest[t]
        d_held *= reset[t]
        dh += d_held
        dh += d_gate @ back_gates
    d_gates, d_news = d_gates.reshape(-1, 2 * UNITS), d_news.reshape(-1, UNITS)
    g["state"], g["gates"] = held.reshape(-1, UNITS).T @ d_news, before.reshape(-1, UNITS).T @ d_gates
    g["inputs"] = np.concatenate([d_gates, d_news], axis=1)  # by step and lane; the trainer adds up equal inputs
    return g, states[-1]


def summed_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Truncated backpropagation with adaptive steps over batches of texts."""

    def __init__(self, w: Weights):
        self.w = {name: value.copy() for name, value in w.items()}
        self.power = {name: np.full(shape, 1e-4, np.float32) for name, shape in SHAPES.items()}
        self.seen = 0

    def learn(self, texts: list[np.ndarray]) -> None:
        """Stretches of similar length side by side; the state is carried from window to window of a stretch."""
        texts = sorted((t[i : i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)), key=len, reverse=True)
        for at in range(0, len(texts), LANES):
            lanes = texts[at : at + LANES]
            h = np.zeros((len(lanes), UNITS), np.float32)
            for previous, target, mask in windows(lanes, STEPS):
                g, h = gradients(self.w, previous, target, mask, h[: previous.shape[1]])
                used, grad = summed_rows(previous.ravel(), g.pop("inputs"))
                power = self.power["inputs"][used] + grad * grad
                self.power["inputs"][used] = power
                self.w["inputs"][used] -= RATE * grad / np.sqrt(power)
                for name, grad in g.items():
                    self.power[name] += grad * grad
                    self.w[name] -= RATE * grad / np.sqrt(self.power[name])
                self.seen += int(mask.sum())


def windows(lanes: list[np.ndarray], steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets and mask (steps, active lanes) of texts that are in order of falling length."""
    lengths = np.array([len(x) for x in lanes])
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    every = np.concatenate(lanes)
    before = np.concatenate([[END_ID], every[:-1]])
    before[offsets] = END_ID
    for start in range(0, int(lengths[0]), steps):
        active = int(np.searchsorted(-lengths, -start))
        size = min(steps, int(lengths[0]) - start)
        step = start + np.arange(size)[:, None]
        mask = step < lengths[None, :active]
        at = np.minimum(step, lengths[None, :active] - 1) + offsets[None, :active]
        yield before[at], every[at], mask


def score(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each whole text; the state is carried across its windows."""
    every = np.argsort([-len(x) for x in texts], kind="stable")
    total = np.zeros(len(texts))
    held: list[tuple] = []
    size = 0
    half = halved(w)

    def settle() -> None:
        states, targets, lane = (np.concatenate(c) for c in zip(*held))
        total[:] += np.bincount(lane, log_probability(w, states, targets), len(texts))

    for at in range(0, len(every), SIDE):
        order = every[at : at + SIDE]
        h = np.zeros((len(order), UNITS), np.float32)
        for previous, target, mask in windows([texts[i] for i in order], STEPS):
            states = advance(half, previous, h[: previous.shape[1]])
            h = states[-1]
            on = np.flatnonzero(mask.ravel())
            held.append((states.reshape(-1, UNITS)[on], target.ravel()[on], order[on % mask.shape[1]]))
            size += len(on)
            if size >= SETTLE:
                settle()
                held, size = [], 0
    if held:
        settle()
    return total


# --- words and their counts ----------------------------------------------------------
def with_dictionaries(docs: DataFrame, held_out: Column, id_column: str, text_column: str) -> DataFrame:
    """One table of texts (``kind`` 1) and of the words of each block of texts (``kind`` 0), written once.

    A block is what a task meets in a row, up to ``DICTIONARY_CHARS``; its words
    carry their number in the block's training texts.
    """
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)
    names = ["block", "kind", "word", "n", "id", "held_out", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        counts: Counter = Counter()

        def words() -> pa.RecordBatch:
            n = len(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{number}"] * n), pa.array([0] * n, pa.int32()), pa.array(list(counts), pa.binary()),
                 pa.array(list(counts.values()), pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.string())], names)

        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                for _, held, text in some:
                    found = tokens(text)
                    if held:
                        counts.update(dict.fromkeys(found, 0))
                    else:
                        counts.update(found)
                    size += len(text or "")
                n = len(some)
                ids, held, texts = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{number}"] * n), pa.array([1] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                     pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array(texts, pa.string())], names)
                if size >= DICTIONARY_CHARS:
                    yield words()
                    number, size = number + 1, 0
                    counts.clear()
        if counts:
            yield words()

    schema = f"block string, kind int, word binary, n bigint, id {key.simpleString()}, held_out boolean, text string"
    picked = docs.select(docs[id_column].alias("id"), held_out.alias("held_out"), docs[text_column].alias("text"))
    return materialise(picked.mapInArrow(run, schema))


@dataclass
class Vocabulary:
    """The most frequent training words have a slot each; the rest share the slot of unknown words."""

    slots: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int

    @property
    def rest(self) -> float:
        """Smoothed count of all words without a slot, one unseen word included."""
        return float(self.tokens + self.types + 1 - (self.counts[END_ID:] + (self.counts[END_ID:] > 0)).sum())


def vocabulary(counted: DataFrame) -> Vocabulary:
    """Totals of the corpus, and its ``SLOTS`` - 2 most frequent words (ties: the smaller first)."""
    first = counted.where("first AND c > 0")
    n, v = first.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = first.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = first.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(SLOTS - FIRST_WORD).select("word", "c").collect()
    counts = np.array([n - end - sum(r["c"] for r in top), end, *[r["c"] for r in top]], np.float64)
    return Vocabulary({END: END_ID} | {bytes(r["word"]): i for i, r in enumerate(top, FIRST_WORD)}, counts, n, v)


# --- training and scoring on Spark -------------------------------------------------------
def train(texts: DataFrame, words: Vocabulary, rounds: int = ROUNDS, share: int = ROUND_SHARE) -> Weights:
    """Average the weights that each task learns from its texts, once per round.

    ``texts`` has ``id`` and ``text``, training texts only. Every round takes its
    own part of them (by a hash of id and text) and begins with the average of the
    round before; the average is taken by an aggregation over weight numbers.
    """
    spark = prepare(texts.sparkSession)
    w = initial(words.counts)
    turn = F.pmod(F.xxhash64("id", "text", F.lit("round")), F.lit(share))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast((w, words.slots))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, slots = shared.value
            trainer = Trainer(start)
            for batch in batches:
                ids = [np.array([slots.get(x, UNKNOWN_ID) for x in tokens(t)]) for t in batch.column(0).to_pylist()]
                for at in range(0, len(ids), 4 * LANES):
                    trainer.learn(ids[at : at + 4 * LANES])
            if trainer.seen:
                values = flat(trainer.w).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * trainer.seen),
                     pa.array(np.full(len(values), trainer.seen))], ["i", "v", "n"])

        learned = texts.where(turn == number).select("text").mapInArrow(run, "i int, v double, n bigint")
        rows = learned.groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).toArrow()
        if rows.num_rows:
            values = np.empty(rows.num_rows)
            values[rows["i"].to_numpy()] = rows["v"].to_numpy()
            w = unflat(values)
        shared.unpersist()
    return w


def score_documents(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words of all rows outside ``held_out`` are counted; a word's total meets the
    blocks of texts that contain it, so no task and not the driver needs the
    counts of all words. ``base_score`` is the smoothed unigram score; ``score``
    the recurrent model's log10 probability of the whole text, where a word
    without a slot has the probability of an unknown word times its share of the
    smoothed counts of such words. A block's dictionary and texts come to one
    task in order, dictionary first.

    Null text counts as empty: the end alone. Repeated rows are counted and
    scored like any others, a null id stays null, an empty table gives an empty
    table, other columns are not read. Without training rows every token scores 0.
    """
    spark = prepare(docs.sparkSession)
    every = with_dictionaries(docs, held_out, id_column, text_column)
    by_word = Window.partitionBy("word")
    counted = materialise(every.where("kind = 0").select(
        "block", "word", F.sum("n").over(by_word).alias("c"),
        (F.row_number().over(by_word.orderBy("block")) == 1).alias("first"),
    ))
    words = vocabulary(counted)
    texts = every.where("kind = 1")
    w = train(texts.where("NOT held_out").select("id", "text"), words)
    shared = spark.sparkContext.broadcast((w, words))
    key = docs.schema[id_column].dataType
    id_type = to_arrow_type(key)
    union = counted.select("block", F.lit(0).alias("kind"), "word", "c", F.lit(None).cast(key).alias("id"),
                           F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("string").alias("text")).unionAll(
        texts.select("block", "kind", "word", F.col("n").alias("c"), "id", "held_out", "text")
    )
    fields = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for out in scorer.take(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *out[1:]], ["id", *Scorer.FIELDS])
        for out in scorer.flush():
            yield pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *out[1:]], ["id", *Scorer.FIELDS])

    scored = union.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, f"id {key.simpleString()}, {fields}")
    return scored.withColumnRenamed("id", id_column)


class Scorer:
    """Takes the sorted rows of a partition: a block's dictionary, then its texts."""

    FIELDS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def __init__(self, w: Weights, words: Vocabulary):
        self.w, self.words = w, words
        self.block, self.index = None, {}
        self.counts: list[int] = []
        self.table: tuple | None = None
        self.rows: list[tuple] = []
        self.size = 0

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        block = batch.column(0).dictionary_encode()
        run = np.stack([block.indices.to_numpy(), batch.column(1).to_numpy()])
        edges = np.flatnonzero((run[:, 1:] != run[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(begin, end - begin)
            name = part.column(0)[0].as_py()
            if name != self.block:
                yield from self.flush()
                self.block, self.index, self.counts, self.table = name, {}, [], None
            if run[1, begin] == 0:
                at = len(self.counts)
                self.index.update(zip(part.column(2).to_numpy(zero_copy_only=False), range(at, at + part.num_rows)))
                self.counts.extend(part.column(3).to_numpy())
                continue
            known = self.index.__getitem__
            for row_id, held, text in zip(*(part.column(i).to_pylist() for i in (4, 5, 6))):
                found = tokens(text)
                self.rows.append((row_id, held, np.fromiter(map(known, found), np.int32, len(found))))
                self.size += len(text or "")
                if self.size >= SCORE_CHARS:
                    yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if not self.rows:
            return
        if self.table is None:
            c = np.array(self.counts, np.float64)
            slot = np.array([self.words.slots.get(x, UNKNOWN_ID) for x in self.index])
            self.table = np.log10(c + 1), c > 0, slot
        log_c, known, slot = self.table
        rows, self.rows, self.size = self.rows, [], 0
        lengths = np.array([len(x) for _, _, x in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        every = np.concatenate([x for _, _, x in rows])
        n, v = self.words.tokens, self.words.types
        base = np.add.reduceat(log_c[every], starts) - lengths * np.log10(n + v + 1)
        ids = slot[every]
        rare = np.add.reduceat(np.where(ids == UNKNOWN_ID, log_c[every] - np.log10(self.words.rest), 0.0), starts)
        model = score(self.w, np.split(ids, starts[1:])) / np.log(10) if n else np.zeros(len(rows))
        yield (
            [r[0] for r in rows], pa.array([r[1] for r in rows], pa.bool_()), pa.array(lengths, pa.int64()),
            pa.array(np.add.reduceat(known[every].astype(np.int64), starts)), pa.array(np.full(len(rows), n, np.int64)),
            pa.array(base), pa.array(model + rare),
        )
