"""One model for two tasks: the category of a text and a flag for each of its words.

Both heads share the word vectors: a word's vector is the mean of the rows of one hashed table for its form, its shape and
its neighbours; a text's vector is the mean over its words. One pass over the texts turns them into hash indices
(``features``), written once; training and scoring read only those. The joint loss, a weighted sum of the mean
log loss over texts and over words, is minimised by full-batch steps: every task sums the gradient of its rows, two
levels of grouping add the tasks' sums in blocks of the parameters, and the driver holds nothing but the parameters,
whose number is fixed by ``Shape``. A step that does not lower the loss is halved and tried again, so the history falls.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..session import cut_lineage

PER_WORD = 5  # the word, its shape, the shape without repeats, and both neighbours
BLOCK = 8192  # parameters summed together
FAN_IN = 32  # partial sums added by one task of the first level
PIECE_WORDS = 1 << 15  # words of whole texts that a task works on at once; a longer text goes alone
PIECE_SHARES = 1 << 20  # class shares of texts that a task holds at once
CELLS_PER_WORD = 40  # cells of the matrix of texts and indices that cost as much as a word without it
LONG = 64  # bytes of a word beyond which it is hashed alone


@dataclass(frozen=True)
class Shape:
    """Sizes of the model; the parameters are ``features * width`` and the two heads."""

    classes: int
    features: int = 1 << 12
    width: int = 16

    @property
    def sizes(self) -> list[tuple[int, ...]]:
        return [(self.features, self.width), (self.classes, self.width + 1), (2, self.width + 1)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.sizes])
        return [part.reshape(size) for part, size in zip(np.split(flat, ends[:-1]), self.sizes)]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(0, 0.1, int(np.prod(size))) for size in self.sizes])


@dataclass
class JointModel:
    shape: Shape
    flat: np.ndarray
    weights: tuple[float, float]
    history: list[float] = field(default_factory=list)  # joint loss of every accepted step


_SHAPES = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def _crc_steps() -> np.ndarray:
    """What each byte adds to a CRC-32."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> 1), steps >> 1)
    return steps


_STEPS = _crc_steps()


def _hashed(kinds: list[bytes], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``crc32(kind + word)`` for each kind and each word, a run of the bytes; all words take a step together, except very long ones."""
    stepped = np.where(sizes > LONG, 0, sizes)
    order = np.argsort((LONG - stepped).astype(np.uint8), kind="stable")
    begin, lengths = starts[order], -stepped[order]
    state = np.repeat(np.array([crc32(kind) for kind in kinds], np.uint32)[:, None] ^ np.uint32(0xFFFFFFFF), len(sizes), axis=1)
    for at in range(int(stepped.max(initial=0))):
        n = np.searchsorted(lengths, -at)  # words of more than so many bytes
        now = state[:, :n]
        state[:, :n] = _STEPS[(now ^ data[begin[:n] + at]) & 255] ^ (now >> 8)
    hashed = np.empty_like(state)
    hashed[:, order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG):
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        hashed[:, i] = [crc32(kind + word) for kind in kinds]
    return hashed


def word_indices(words: pa.Array, sizes: np.ndarray, features: int) -> np.ndarray:
    """``PER_WORD`` hash indices for each word of texts that follow each other; every different word is hashed once."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.cast(pa.large_string())
    _, ends, data = distinct.buffers()
    ends = np.frombuffer(ends or bytes(8), np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(data or b"", np.uint8)[: ends[-1]]
    starts, lengths = ends[:-1], np.diff(ends)
    shapes = _SHAPES[data]
    new = np.concatenate([[True], shapes[1:] != shapes[:-1]])[: len(data)]  # not a repeat of the byte before it
    new[starts[lengths > 0]] = True
    to = np.concatenate([[0], np.cumsum(new)])
    own, left, right = _hashed([b"w", b"<", b">"], data, starts, lengths)
    (shape,), (short,) = _hashed([b"s"], shapes, starts, lengths), _hashed([b"q"], shapes[new], to[starts], to[ends[1:]] - to[starts])
    # The ends of a text have the empty word for a neighbour.
    left, right = np.append(left, np.uint32(crc32(b"<"))), np.append(right, np.uint32(crc32(b">")))
    last = np.cumsum(sizes)[sizes > 0] - 1
    before, after = np.roll(codes, 1), np.roll(codes, -1)
    before[last + 1 - sizes[sizes > 0]] = after[last] = len(distinct)
    return np.stack([own[codes], shape[codes], short[codes], left[before], right[after]], axis=1) % np.uint32(features)


def _pieces(batches, column: str, classes: int = 1):
    """The rows of the batches in runs of at most ``PIECE_WORDS`` entries of the list column and ``PIECE_SHARES`` class shares together."""
    most = max(1, PIECE_SHARES // classes)
    for batch in batches:
        ends = np.cumsum(_sizes(batch.column(column)))
        begin = done = 0
        while begin < len(ends):
            end = min(max(begin + 1, int(np.searchsorted(ends, done + PIECE_WORDS, "right"))), begin + most)
            yield batch.slice(begin, end - begin)
            begin, done = end, ends[end - 1]


def _sizes(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _kind(size: int) -> type:
    """Of the numbers in a packed row of indices."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _lists(entries: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(entries, pa.int32()))


def _indexed(size: int):
    def run(batches):
        for batch in _pieces(batches, "words"):
            sizes, own = _sizes(batch.column(2)), _sizes(batch.column(3))
            indices = word_indices(batch.column(2).flatten(), sizes, size).astype(_kind(size))
            ends = np.concatenate([[0], np.cumsum(sizes)]) * PER_WORD * indices.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(indices)]).cast(pa.binary())
            # A word has the flag at its place; one without is masked, and flags without a word are dropped.
            given = batch.column(3).flatten().fill_null(texts.MASKED_LABEL).to_numpy(zero_copy_only=False)
            flags = np.full(sizes.sum(), texts.MASKED_LABEL, np.int32)
            at = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flags[at(sizes) < np.repeat(own, sizes)] = given[at(own) < np.repeat(sizes, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, _lists(flags, sizes)], ["ident", "category", "idx", "flags"])

    return run


def features(df: DataFrame, ident: str, text: str, category: str, labels: str, size: int, words: str | None = None) -> DataFrame:
    """``ident, category, idx, flags`` per text, as a written table: the pass both heads share.

    ``idx`` has the hash indices of all words as packed numbers, since lists of them cost more to move than to learn from.
    ``category`` counts from zero; ``labels`` has one flag per word. A text without words has empty lists and takes part in neither loss,
    one without category only in that of the words; masked and null flags take part in none. ``words`` names a column
    with the words of the text where they are at hand.
    """
    kind = df.schema[ident].dataType.simpleString()
    rows = df.select(ident, F.col(category).cast("int").alias("category"), (F.col(words) if words else texts.words(F.col(text))).alias("words"), F.col(labels).cast("array<int>").alias("flags"))
    return cut_lineage(rows.mapInArrow(_indexed(size), f"ident {kind}, category int, idx binary, flags array<int>"), "joint-features")


def _softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def _summed(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each key."""
    return np.stack([np.bincount(keys, column, minlength=n) for column in rows.T], axis=1)


def _indices(column: pa.Array, features: int) -> np.ndarray:
    """The hash indices of all words, one row for each, from packed numbers or lists."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.intp).reshape(-1, PER_WORD)
    _, ends, entries = column.buffers()
    ends = np.frombuffer(ends, np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(entries or b"", np.uint8)[ends[0] : ends[-1]].view(_kind(features))
    return numbers.astype(np.intp).reshape(-1, PER_WORD)


class _Piece:
    """Some whole texts as their words' indices; ``times`` and ``back`` multiply by the matrix of how often each text has each index, and by its transpose."""

    def __init__(self, shape: Shape, batch: pa.RecordBatch):
        self.shape, self.sizes = shape, _sizes(batch.column("flags"))
        self.idx = _indices(batch.column("idx"), shape.features)
        self.flags = batch.column("flags").flatten().to_numpy(zero_copy_only=False)
        self.own = batch.column("category").fill_null(-1).to_numpy(zero_copy_only=False)
        self.known = (self.own >= 0) & (self.own < shape.classes) & (self.sizes > 0)
        self.seen = (self.flags == 0) | (self.flags == 1)
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.counts = None
        if len(self.sizes) * shape.features <= CELLS_PER_WORD * len(self.idx):  # texts long enough for the matrix itself
            cells = (self.idx + (self.of * shape.features)[:, None]).ravel()
            self.counts = np.bincount(cells, minlength=len(self.sizes) * shape.features).astype(float).reshape(-1, shape.features)

    def times(self, table: np.ndarray) -> np.ndarray:
        if self.counts is not None:
            return self.counts @ table
        return _summed(self.of, sum((table[self.idx[:, k]] for k in range(PER_WORD)), np.zeros((len(self.idx), table.shape[1]))), len(self.sizes))

    def back(self, rows: np.ndarray) -> np.ndarray:
        if self.counts is not None:
            return self.counts.T @ rows
        of_words = rows[self.of]
        return sum(_summed(self.idx[:, k], of_words, self.shape.features) for k in range(PER_WORD))


def _forward(shape: Shape, flat: np.ndarray, piece: _Piece):
    """Vectors and class shares of the texts of a piece, and by how much the second class of its words leads the first."""
    table, by_text, by_word = shape.split(flat)
    docs = piece.times(table) / (PER_WORD * np.maximum(piece.sizes, 1))[:, None]
    lead = by_word[1] - by_word[0]
    # A word's vector is a mean of rows, so that the head can be applied to the rows before they are met.
    ahead = (table @ lead[:-1] / PER_WORD)[piece.idx] @ np.ones(PER_WORD) + lead[-1]
    return docs, _softmax(docs @ by_text[:, :-1].T + by_text[:, -1]), ahead


def _word_shares(ahead: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The share of each word's own class."""
    return 1 / (1 + np.exp(np.minimum(np.where(flags == 1, -ahead, ahead), 700)))


def _partial(shape: Shape, flat: np.ndarray):
    """Per task: sums of the two losses and their counts, and of the gradients of both, as blocks."""
    total = len(flat)
    _, text_head, word_head = shape.split(flat)

    def run(batches):
        loss, grads = np.zeros(4), np.zeros((2, total))
        (table_t, head_t, _), (table_w, _, head_w) = shape.split(grads[0]), shape.split(grads[1])
        met, errors = np.zeros(shape.features), 0.0  # of the words' errors: their sums by index, and in all
        for batch in _pieces(batches, "flags", shape.classes):
            piece = _Piece(shape, batch)
            docs, by_text, ahead = _forward(shape, flat, piece)
            at = np.flatnonzero(piece.known)
            loss[:2] += -np.log(np.maximum(by_text[at, piece.own[at]], 1e-15)).sum(), len(at)
            error = by_text * piece.known[:, None]
            error[at, piece.own[at]] -= 1
            head_t += error.T @ np.concatenate([docs, np.ones((len(docs), 1))], axis=1)
            table_t += piece.back(error @ text_head[:, :-1] / (PER_WORD * np.maximum(piece.sizes, 1))[:, None])
            share = _word_shares(ahead, piece.flags)
            loss[2:] += -(np.log(np.maximum(share, 1e-15)) * piece.seen).sum(), piece.seen.sum()
            wrong = np.where(piece.flags == 1, share - 1, 1 - share) * piece.seen  # of the second class; the first has the opposite
            met += np.bincount(piece.idx.ravel(), np.repeat(wrong, PER_WORD), shape.features)
            errors += wrong.sum()
        table = shape.split(flat)[0]
        head_w[1] = np.concatenate([met @ table / PER_WORD, [errors]])
        head_w[0] = -head_w[1]
        table_w += np.outer(met, word_head[1, :-1] - word_head[0, :-1]) / PER_WORD
        both = np.concatenate([loss, grads.ravel()])
        starts = range(0, len(both), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(starts)), pa.int32()), pa.array([both[s : s + BLOCK] for s in starts], pa.list_(pa.float64()))], ["block", "v"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of the rows of one block, one row."""
    width = len(table["v"][0])
    rows = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return pa.table({"block": table["block"].slice(0, 1), "v": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})


def loss_and_gradient(rows: DataFrame, shape: Shape, flat: np.ndarray, weights: tuple[float, float]) -> tuple[float, np.ndarray]:
    """The joint loss over all rows and its gradient; a task whose count is zero adds nothing."""
    kind = "block int, v array<double>"
    partial = rows.mapInArrow(_partial(shape, flat), kind).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    halfway = partial.groupBy("block", "part").applyInArrow(lambda t: _added(t.drop(["part"])), kind)
    summed = halfway.groupBy("block").applyInArrow(_added, kind).toArrow()  # one row per block of parameters
    if not summed.num_rows:
        return 0.0, np.zeros_like(flat)
    order = np.argsort(summed["block"].to_numpy())
    blocks = summed["v"].to_pylist()
    both = np.concatenate([blocks[i] for i in order])
    (text_loss, n_text, word_loss, n_word), grads = both[:4], both[4:].reshape(2, -1)
    a, b = weights[0] / max(n_text, 1), weights[1] / max(n_word, 1)
    return float(a * text_loss + b * word_loss), a * grads[0] + b * grads[1]


def train_joint(rows: DataFrame, shape: Shape, weights: tuple[float, float] = (1.0, 1.0), iterations: int = 12, rate: float = 0.3, seed: int = 42) -> JointModel:
    """Fit to ``features`` rows. ``history`` has the loss before the first step and after every step that lowered it."""
    flat = shape.start(seed)
    loss, grad = loss_and_gradient(rows, shape, flat, weights)
    history, mean, square = [loss], np.zeros_like(flat), np.zeros_like(flat)
    for i in range(1, iterations + 1):
        mean, square = 0.8 * mean + 0.2 * grad, 0.95 * square + 0.05 * grad**2
        ahead = mean / (1 - 0.8**i) / (np.sqrt(square / (1 - 0.95**i)) + 1e-8)
        for _ in range(4):
            tried = flat - rate * ahead
            new_loss, new_grad = loss_and_gradient(rows, shape, tried, weights)
            if new_loss < loss:
                flat, loss, grad = tried, new_loss, new_grad
                history.append(loss)
                break
            rate /= 2
        else:
            break
    return JointModel(shape, flat, weights, history)


def joint_scores(model: JointModel, rows: DataFrame) -> DataFrame:
    """Per text ``ident, n_words, category_share, right`` (null without category or words), ``flagged``, ``flags_right`` and ``word_loss``."""
    shape, flat, kind = model.shape, model.flat, rows.schema["ident"].dataType.simpleString()

    def run(batches):
        for batch in _pieces(batches, "flags", shape.classes):
            piece = _Piece(shape, batch)
            _, by_text, ahead = _forward(shape, flat, piece)
            own, known, flags, seen = piece.own, piece.known, piece.flags, piece.seen
            told = ahead > 0
            loss = -np.log(np.maximum(_word_shares(ahead, flags), 1e-15)) * seen
            count = lambda x: np.bincount(piece.of, x, minlength=len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ident"), pa.array(piece.sizes), pa.array(by_text[np.arange(len(own)), np.where(known, own, 0)], mask=~known),
                    pa.array(by_text.argmax(axis=1) == own, mask=~known), pa.array(count(told).astype(np.int64)),
                    pa.array(count((told == flags) & seen).astype(np.int64)), pa.array(count(loss).astype(float)),
                ],
                ["ident", "n_words", "category_share", "right", "flagged", "flags_right", "word_loss"],
            )

    return rows.mapInArrow(run, f"ident {kind}, n_words bigint, category_share double, right boolean, flagged bigint, flags_right bigint, word_loss double")
