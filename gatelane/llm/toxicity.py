"""Toxicity by a small convolutional text classifier, trained in numpy.

The embedding of a word is the sum of three rows of hashed tables: two chosen by different bits
of the CRC-32 of its lower-cased bytes (two words share both only once in 2**30), one by the CRC-32
of its first bytes, so that unseen words with a known stem are met. Filters of several widths run over the words; each filter keeps its largest
response over the whole text (max pooling), and a linear layer makes the logit.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents with at most ``SAMPLE_WORDS`` words (the only
bounds; whole documents are drawn by a hash of the identifier among all that may be learnt from). Thresholds are
calibrated per language on a part of them that the training does not see; the language
is guessed from the letters of the text itself. The score is the logit shifted by the threshold,
so that 0.5 is the cut everywhere. Scoring reads every word of every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SAMPLE = 8_000  # labelled rows the classifier is fitted on, at most
SAMPLE_WORDS = 20_000_000  # of all sampled documents together: what the driver holds
BITS, DIM, WIDTHS, FILTERS = 15, 16, (1, 2, 3), 8
PAD = max(WIDTHS) - 1
STEM = 5
SIDES = 3
PIECE = 50_000  # words convolved at once
FOLDS = 5  # rows whose hashed identifier is 0 modulo this are never learnt from

# Letters that tell a language; a text with few of them is "other".
LETTERS = {"de": "äöüß", "es": "ñáíóúñ¿¡", "fr": "àâçèêëîïôùûœ"}
LETTER_SHARE = 0.004

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def word_hashes(text: bytes) -> np.ndarray:
    """Per word the CRC-32 of the word, and in the upper half that of its first ``STEM`` bytes.

    Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased.
    """
    words = text.translate(_FOLD).split()
    whole = np.fromiter(map(crc32, words), np.uint64, len(words))
    return whole | np.fromiter((crc32(w[:STEM]) for w in words), np.uint64, len(words)) << np.uint64(32)


def guess_language(text: str) -> str:
    counts = {name: sum(map(text.count, set(letters))) for name, letters in LETTERS.items()}
    best = max(sorted(counts), key=counts.get)
    return best if counts[best] > LETTER_SHARE * len(text) else "other"


@dataclass
class Model:
    tables: np.ndarray  # SIDES, 2**BITS + 1, DIM; the last row of each is the padding and stays zero
    filters: list[np.ndarray]  # per width: width, DIM, FILTERS
    shifts: np.ndarray  # widths * FILTERS
    weights: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << BITS) - 1)
        shifts = (0, 32 - BITS, 32)
        return np.stack([(hashes >> np.uint64(s)) & low for s in shifts]).astype(np.int32)

    def _responses(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses at each word of padded rows (SIDES, n + PAD) to (n, widths * FILTERS)."""
        own = sum(t[r] for t, r in zip(self.tables, rows))
        n = rows.shape[1] - PAD
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, (width, bank) in enumerate(zip(WIDTHS, self.filters)):
            part = own[:n] @ bank[0]
            for j in range(1, width):
                part += own[j : n + j] @ bank[j]
            out[:, i * FILTERS : (i + 1) * FILTERS] = part
        return out

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest response per filter and text. Long texts go in pieces that overlap by the filter width."""
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            rows = np.concatenate([r for _, r in pending], axis=1)
            starts = np.cumsum([0] + [r.shape[1] for _, r in pending])
            # The padding behind each piece takes part in windows that begin in the piece only.
            tail = np.full((SIDES, PAD), 1 << BITS, np.int32)
            responses = self._responses(np.concatenate([rows, tail], axis=1))
            for (i, r), a in zip(pending, starts):
                np.maximum(best[i], responses[a : a + r.shape[1] - PAD].max(0), out=best[i])

        for i, hashes in enumerate(texts):
            words = self.words(hashes) if len(hashes) else np.full((SIDES, 1), 1 << BITS, np.int32)
            words = np.concatenate([words, np.full((SIDES, PAD), 1 << BITS, np.int32)], axis=1)
            for a in range(0, words.shape[1] - PAD, PIECE):
                piece = words[:, a : a + PIECE + PAD]
                if size and size + piece.shape[1] > PIECE:
                    flush()
                    pending, size = [], 0
                pending.append((i, piece))
                size += piece.shape[1]
        if pending:
            flush()
        return best

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.maximum(self.pooled(texts) + self.shifts, 0) @ self.weights + self.bias

    def scores(self, texts: list[np.ndarray], languages: list[str]) -> np.ndarray:
        cuts = np.array([self.thresholds.get(name, 0.0) for name in languages])
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - cuts, -50, 50)))


def empty_model(bias: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    tables = rng.normal(0, 0.05, (SIDES, (1 << BITS) + 1, DIM)).astype(np.float32)
    tables[:, -1] = 0
    filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    n = len(WIDTHS) * FILTERS
    return Model(tables, filters, np.full(n, 0.05, np.float32), rng.uniform(0.3, 0.6, n).astype(np.float32), bias)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.turn = rate, {}, 0

    def step(self, name, values, grad, rows=None):
        """In-place update; with ``rows`` only those rows of ``values``."""
        if name not in self.state:
            self.state[name] = (np.zeros_like(values), np.zeros_like(values))
        one, two = self.state[name]
        at = slice(None) if rows is None else rows
        one[at] = 0.9 * one[at] + 0.1 * grad
        two[at] = 0.99 * two[at] + 0.01 * grad * grad
        t = self.turn
        values[at] -= self.rate * (one[at] / (1 - 0.9**t)) / (np.sqrt(two[at] / (1 - 0.99**t)) + 1e-6)


def train(texts: list[np.ndarray], marks: np.ndarray, seed: int = 11, epochs: int = 8, batch: int = 64, rate: float = 0.02) -> Model:
    """Logistic loss, both classes weighed alike; gradients flow through the position each filter picked."""
    share = float(marks.mean()) if len(marks) else 0.0
    if not 0 < share < 1:
        model = empty_model(20.0 if share else -20.0, seed)
        model.weights[:] = 0
        return model
    model, rng, adam = empty_model(0.0, seed), np.random.default_rng(seed), _Adam(rate)
    heavy = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    pad = np.full((SIDES, PAD), 1 << BITS, np.int32)
    padded = [np.concatenate([model.words(t) if len(t) else pad[:, :1], pad], axis=1) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(padded))
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            rows = np.concatenate([padded[i] for i in chosen] + [pad], axis=1)
            lengths = np.array([padded[i].shape[1] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            responses = model._responses(rows)
            for a, n in zip(starts, lengths):  # windows that begin in the padding do not count
                responses[a + n - PAD : a + n] = -np.inf
            peaks = np.array([responses[a : a + n].argmax(0) + a for a, n in zip(starts, lengths)])
            before = np.take_along_axis(responses, peaks, 0) + model.shifts
            hidden = np.maximum(before, 0)
            y = marks[chosen]
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.bias, -30, 30)))
            delta = ((p - y) * np.where(y == 1, heavy[1], heavy[0]) / len(chosen)).astype(np.float32)
            back = delta[:, None] * model.weights * (before > 0)
            adam.turn += 1
            grads = {"weights": hidden.T @ delta, "shifts": back.sum(0)}
            touched, sums = [], []
            for i, (width, bank) in enumerate(zip(WIDTHS, model.filters)):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                grad = np.zeros_like(bank)
                for j in range(width):
                    at = peaks[:, cols] + j
                    own = sum(t[r[at]] for t, r in zip(model.tables, rows))  # docs, FILTERS, DIM
                    grad[j] = np.einsum("dfk,df->kf", own, back[:, cols])
                    touched.append(at.ravel())
                    sums.append((back[:, cols][:, :, None] * bank[j].T[None]).reshape(-1, DIM))
                adam.step(f"bank{i}", bank, grad + 1e-4 * bank)
            where, values = np.concatenate(touched), np.concatenate(sums)
            for side in range(SIDES):
                ids, inverse = np.unique(rows[side][where], return_inverse=True)
                total = np.zeros((len(ids), DIM), np.float32)
                np.add.at(total, inverse, values)
                live = ids < (1 << BITS)
                if live.any():
                    adam.step(f"table{side}", model.tables[side], total[live], ids[live])
            adam.step("weights", model.weights, grads["weights"] + 1e-4 * model.weights)
            adam.step("shifts", model.shifts, grads["shifts"])
            bias = np.array([model.bias], np.float32)
            adam.step("bias", bias, np.array([delta.sum()], np.float32))
            model.bias = float(bias[0])
    return model


def calibrate(model: Model, texts: list[np.ndarray], marks: np.ndarray, languages: list[str], least: int = 30) -> None:
    """Per language the cut with the fewest errors, both kinds counting alike per document; in the middle of the best stretch.

    A language with fewer than ``least`` rows, or with one class only, takes the cut of all together.
    """
    logits = model.logits(texts)

    def best(z, y):
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        # Cut before place i: toxic rows below it are missed, clean ones from it on are false alarms.
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
        edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
        good = np.flatnonzero(errors == errors.min())
        return float(edges[good[len(good) // 2]])

    names = np.array(languages, dtype=object)
    both = lambda y: len(y) >= least and 0 < y.mean() < 1
    common = best(logits, marks) if both(marks) else 0.0
    for name in [*LETTERS, "other"]:
        own = names == name
        model.thresholds[name] = best(logits[own], marks[own]) if own.any() and both(marks[own]) else common


def fold(ident: str | Column) -> Column:
    """0 to FOLDS - 1 by the CRC-32 of the identifier as text; a null one counts as empty."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    return (F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def fit(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", mark: str = "toxic", sample: int = SAMPLE, seed: int = 11,
    most_words: int = SAMPLE_WORDS,
) -> Model:
    """Train and calibrate on up to ``sample`` labelled documents outside fold 0 with up to ``most_words`` words together.

    Only labels 0 and 1 count; several labels of one document count as the largest, and of several texts of one
    identifier one is taken. Documents are drawn in the order of a seeded hash of their identifier.
    Without labelled rows, or with one class only, the model says one class for every text.
    """
    known = (
        labels.filter(F.col(mark).isin(0, 1) & F.col(ident).isNotNull() & (fold(ident) != 0))
        .groupBy(F.col(ident).alias("_ident")).agg(F.max(mark).cast("int").alias("_mark"))
        .withColumn("_place", F.xxhash64("_ident", F.lit(seed))).orderBy("_place", "_ident").limit(sample)
    )

    def run(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            hashes = [word_hashes((t or "").encode()).view(np.int64) for t in texts]
            at = np.cumsum([0] + [len(h) for h in hashes]).astype(np.int32)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([guess_language(t or "") for t in texts], pa.string()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["ident", "mark", "place", "language", "words"],
            )

    kind = docs.schema[ident].dataType.simpleString()
    one_each = (
        docs.select(F.col(ident).alias("_name"), F.col(text).alias("_text"))
        .join(F.broadcast(known), F.col("_name") == F.col("_ident"))  # at most ``sample`` rows
        .groupBy("_ident", "_mark", "_place").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    )
    rows = written(one_each.mapInArrow(run, f"ident {kind}, mark int, place bigint, language string, words array<bigint>"), "labelled")
    # At most ``sample`` pairs; documents that hash alike come and go together.
    whole, last = 0, None
    for row in sorted(rows.select("place", F.size("words").alias("n")).collect()):
        whole += row["n"]
        if whole > most_words:
            break
        last = row["place"]
    rows = rows.filter(F.lit(False) if last is None else F.col("place") <= last).drop("place").toArrow()
    order = pa.compute.sort_indices(rows, sort_keys=[("ident", "ascending")])
    rows = rows.take(order).combine_chunks()
    column = rows["words"].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    texts = [flat[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:])]
    marks = rows["mark"].to_numpy().astype(np.float32)
    languages = rows["language"].to_pylist()
    held = np.random.default_rng(seed).random(len(texts)) < 0.25
    pick = lambda keep: ([t for t, k in zip(texts, keep) if k], marks[keep], [x for x, k in zip(languages, keep) if k])
    learn, learn_marks, _ = pick(~held)
    model = train(learn, learn_marks, seed)
    calibrate(model, *pick(held))
    return model


def score(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.

    A null or empty text scores what the model says of no word. Nothing but the text
    enters the score. Repeated rows stay; other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: about 6 MB

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            scores = own.scores([word_hashes((t or "").encode()) for t in texts], [guess_language(t or "") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col(ident).alias("doc_id"), (fold(ident) == 0).alias("held_out"), text).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filter_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score under 0.5."""
    names, at = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            scores = own.scores([word_hashes((t or "").encode()) for t in texts], [guess_language(t or "") for t in texts])
            yield batch.filter(pa.array(scores < 0.5))

    return docs.select(*names).mapInArrow(run, docs.schema)
