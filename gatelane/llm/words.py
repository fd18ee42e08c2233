"""Words of whole Arrow batches as arrays: a byte transducer and hashes of word spans.

The transducer is two tables over byte classes. Its state only says whether a word is open, and the class of
a byte alone decides the next state, so the state before every byte is known at once and a whole
batch passes in a few array lookups.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .suffix_core import mix

SPACE, CAPITAL, SYMBOL, PLAIN, CONTINUATION, LEAD = range(6)
BETWEEN, INSIDE = 0, 1
BEGINS, ENDS, IS_CAPITAL, IS_POINT, IS_SYMBOL = 1, 2, 4, 8, 16
LONG = 64  # words above this many bytes are handled one by one


def _tables(symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = np.full(256, PLAIN, np.uint8)
    classes[list(b" \t\n\x0b\x0c\r")] = SPACE
    classes[ord("A") : ord("Z") + 1] = CAPITAL
    classes[list(symbols)] = SYMBOL
    classes[0x80:0xC0] = CONTINUATION
    classes[0xC0:] = LEAD
    after = np.full(6, INSIDE, np.uint8)
    after[SPACE] = BETWEEN
    emit = np.zeros((2, 6), np.uint8)
    emit[:, CAPITAL] |= IS_CAPITAL
    emit[:, SYMBOL] |= IS_SYMBOL
    emit[:, [SPACE, CAPITAL, SYMBOL, PLAIN, LEAD]] |= IS_POINT
    emit[BETWEEN, [CAPITAL, SYMBOL, PLAIN, CONTINUATION, LEAD]] |= BEGINS
    emit[INSIDE, SPACE] |= ENDS
    return classes, after, emit.ravel()


class Words:
    """The words of a column of texts (no nulls): ``begin`` and ``end`` in ``data``, ``text`` the row of each.

    ``counts(bit)`` gives per row how often the transducer emitted a bit.
    """

    def __init__(self, column: pa.Array, symbols: bytes = b"#$%&*|"):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.data, self.offsets = raw, offsets - offsets[0]
        classes, after, emit = _tables(symbols)
        own = classes[raw]
        state = np.empty(len(raw), np.uint8)
        state[1:] = after[own[:-1]]
        starts = self.offsets[:-1][np.diff(self.offsets) > 0]
        state[starts] = BETWEEN
        self.emitted = emit[state * np.uint8(6) + own]
        self.begin = np.flatnonzero(self.emitted & BEGINS)
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        open_ends = last[after[own[last]] == INSIDE] + 1
        closed = np.flatnonzero(self.emitted & ENDS)
        self.end = np.sort(np.concatenate([closed, open_ends]))
        self.text = np.searchsorted(self.offsets, self.begin, "right") - 1
        self._padded = None

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self, bit: int) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1, np.int64)
        filled = np.flatnonzero(np.diff(self.offsets))
        if len(filled):
            out[filled] = np.add.reduceat((self.emitted & np.uint8(bit)) > 0, self.offsets[filled], dtype=np.int64)
        return out

    def first_word(self) -> np.ndarray:
        """Per row the index of its first word, and one more entry for the end."""
        return np.searchsorted(self.begin, self.offsets)

    def eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The up to eight bytes at each place as an integer, zero beyond ``left`` bytes."""
        if self._padded is None:
            self._padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        view = np.ndarray((len(self.data) + 1,), "<u8", self._padded, strides=(1,))
        unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
        return view[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)

    def bytes_of(self, word: int) -> bytes:
        return self.data[self.begin[word] : self.end[word]].tobytes()

    def hashes(self, seed: int | np.ndarray = 0) -> np.ndarray:
        """64-bit hash of every word's bytes."""
        size = self.end - self.begin
        out = mix(size.astype(np.uint64) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        for step in range(0, LONG, 8):
            some = np.flatnonzero(size > step) if step else slice(None)
            if step and not len(some):
                break
            left = size[some] - step
            out[some] = mix(out[some] * np.uint64(0xFF51AFD7ED558CCD) + self.eight(self.begin[some] + step, left)) if len(size) else out
        for word in np.flatnonzero(size > LONG).tolist():
            rest = int.from_bytes(blake2b(self.bytes_of(word), digest_size=8).digest(), "little")
            out[word : word + 1] = mix(out[word : word + 1] ^ np.uint64(rest))
        return out

    def distinct(self) -> np.ndarray:
        """Per row the number of different words, by inserting all spans into one verified hash table.

        Open addressing over (row, bytes): all open spans try their slot at once, one of them gets it; the others
        compare row, length and bytes with the span that holds it, and go on to the next slot where they differ.
        """
        size, found = self.end - self.begin, np.zeros(len(self.offsets) - 1, np.int64)
        small = np.flatnonzero(size <= LONG)
        if len(small):
            width = np.int64(1 << int(2 * len(small) - 1).bit_length())
            slots = np.full(width, -1, np.int64)
            at = (self.hashes(self.text)[small] & np.uint64(width - 1)).astype(np.int64)
            while len(small):
                free = slots[at] < 0
                slots[at[free]] = small[free]
                holder = slots[at]
                settled = holder == small
                found += np.bincount(self.text[small[settled]], minlength=len(found))
                rest = np.flatnonzero(~settled)
                differ = rest[~self._equal(small[rest], holder[rest])]
                small, at = small[differ], (at[differ] + 1) & (width - 1)
        table: dict[tuple[int, bytes], None] = {}
        for word in np.flatnonzero(size > LONG).tolist():
            table.setdefault((int(self.text[word]), self.bytes_of(word)))
        for row, _ in table:
            found[row] += 1
        return found

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = self.end[a] - self.begin[a]
        same = (self.text[a] == self.text[b]) & (size == self.end[b] - self.begin[b])
        for step in range(0, LONG, 8):
            some = np.flatnonzero(same & (size > step))
            if not len(some):
                break
            left = size[some] - step
            same[some] = self.eight(self.begin[a[some]] + step, left) == self.eight(self.begin[b[some]] + step, left)
        return same
