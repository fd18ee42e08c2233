"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(text):
    import xxhash

    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def simhash_rows(docs):
    """(doc_id, fingerprint, component_id)"""
    prints = [(i, simhash(t)) for i, t in docs]
    distinct = sorted({f for _, f in prints})
    values = np.array(distinct, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    group = components(range(len(distinct)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    place = {f: group[i] for i, f in enumerate(distinct)}
    lowest = {}
    for i, f in prints:
        if i is not None:
            lowest[place[f]] = min(i, lowest.get(place[f], i))
    return sorted(((i, f"{f:016x}", lowest.get(place[f])) for i, f in prints), key=repr)


def without_repeats(texts, span=400):
    """Per text which bytes go."""
    seen = defaultdict(int)
    for t in texts:
        for p in range(len(t) - span + 1):
            seen[t[p : p + span]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                gone[p : p + span] = True
        out.append(gone)
    return out


def rest(text, gone):
    return bytes(b for b, g in zip(text, gone) if not g)


def repeats(texts, span=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) per text."""
    out = []
    for t, gone in zip(texts, without_repeats(texts, span)):
        starts = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(rest(t, gone)).hexdigest()))
    return out


def repeat_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def vector_links(rows, least=0.9):
    """(vec_id, n_links, component_id)"""
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and usable(v)]
    links, edges = Counter(), []
    for x in range(len(good)):
        for y in range(x + 1, len(good)):
            a, b = good[x][1], good[y][1]
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[x] += 1
                links[y] += 1
                edges.append((good[x][0], good[y][0]))
    group = components([i for i, _ in good], edges)
    out = [(i, links[x], group[i]) for x, (i, _) in enumerate(good)]
    return out + [(i, 0, i) for i, v in rows if i is None or not usable(v)]


def repeated_words(texts, width=35):
    """(n_words, n_removed, kept_sha256) per text."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out
