"""Anchored suffixes of one text: the array work behind the suffix index.

Every window of ``span`` bytes is assigned to one anchor inside it: the place, at least
``context_of(span)`` bytes from both ends, whose eight bytes have the smallest hash (the leftmost of
equals). The choice depends on the window's bytes only, so equal windows have anchors at the
same place in them. Neighbouring windows mostly share their anchor; a run of such windows is
one row. A text of n bytes has about 2 n / (span - 2 context_of(span)) anchors.
"""

from __future__ import annotations

import numpy as np

SPAN = 400
LEAST_SPAN, MOST_SPAN = 80, 1000  # eight bytes of an anchor fit on a side; ten bits hold a window's distance from its anchor
_PLACE = np.uint64((1 << 20) - 1)
_CHUNK = (1 << 20) - 2 * MOST_SPAN
_rng = np.random.default_rng(2024)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 1 << 62)) * 4 + 3
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _UNBASE: np.ones(1, np.uint64)}


def context_of(span: int) -> int:
    """Bytes on both sides of an anchor that always belong to its windows: about an eighth of the span."""
    if not LEAST_SPAN <= span <= MOST_SPAN:
        raise ValueError(f"spans have {LEAST_SPAN} to {MOST_SPAN} bytes")
    return span // 8 - 2


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, remembered and doubled on demand."""
    table = _powers[base]
    while len(table) <= n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
    _powers[base] = table
    return table


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a text in constant time."""

    def __init__(self, text: np.ndarray):
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(_BYTES[text] * powers(_BASE, len(text))[: len(text)], out=sums[1:])
        self.sums, self.back = sums, powers(_UNBASE, len(text))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def window_anchors(text: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The anchor of each of the n - span + 1 windows."""
    n, context = len(text), context_of(span)
    reach = span - 2 * context  # places among which a window's anchor is chosen
    out = []
    for base in range(0, n - span + 1, _CHUNK):
        part = text[base : base + _CHUNK + span - 1]
        m = len(part) - 2 * context
        eight = np.zeros(m, np.uint64)
        inner = np.ascontiguousarray(part[context:])
        for shift in range(8):
            rows = (len(inner) - shift) // 8
            words = inner[shift : shift + 8 * rows].view(np.uint64)
            want = len(range(shift, m, 8))
            eight[shift::8] = words[:want]
        keys = (mix(eight) & ~_PLACE) | np.arange(m, dtype=np.uint64)
        count = m - reach + 1
        padded = np.full(-(-m // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        padded[:m] = keys
        blocks = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
        out.append((least & _PLACE).astype(np.int64) + base + context)
    return np.concatenate(out)


def periodic_windows(text: np.ndarray, span: int = SPAN, longest: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal the one ``d`` bytes before or after, d up to ``longest``: (all of them, those with an earlier one)."""
    n = len(text) - span + 1
    same, later = np.zeros(n, bool), np.zeros(n, bool)
    for d in range(1, min(longest, n - 1) + 1):
        differ = np.concatenate([[0], np.cumsum(text[:-d] != text[d:])])
        hit = differ[span : span + n - d] == differ[: n - d]
        same[: n - d] |= hit
        same[d:] |= hit
        later[d:] |= hit
    return same, later


def runs(text: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Anchors, first and last window of each run; and stretches found to repeat inside the text.

    Short periods would make an anchor of every byte. There, one window of each kind
    is kept for the index, and the rest are known to repeat.
    """
    if len(text) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, []
    anchors = window_anchors(text, span)
    places = np.arange(len(anchors))
    known: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    if len(starts) > 64 and len(starts) * 24 > len(anchors):
        same, later = periodic_windows(text, span)
        known = stretches(np.flatnonzero(same), span)
        places = places[~later]
        anchors = anchors[~later]
        fresh = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1] + 1)])
        starts = np.flatnonzero(fresh)
    ends = np.concatenate([starts[1:], [len(anchors)]]) - 1
    return anchors[starts], places[starts], places[ends], known


def stretches(windows: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Bytes covered by the windows that start at the given places, as half-open intervals."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > span)
    begin = windows[np.concatenate([[0], cut + 1])]
    end = windows[np.concatenate([cut, [len(windows) - 1]])] + span
    return list(zip(begin.tolist(), end.tolist()))
