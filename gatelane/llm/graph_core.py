"""Array work on one cell of vectors: robust-pruned graph, beam search, range expansion."""

from __future__ import annotations

import numpy as np

DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def k_means(sample: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; centres that lose all points keep their place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def mean_centres(sample: np.ndarray, k: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Plain k-means by distance, for what the centres of ``k_means`` leave over."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        half = (centres**2).sum(1) / 2
        near = np.concatenate([(sample[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(sample), 4096)])
        sums, count = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, sample)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def covers(queries: np.ndarray, vectors: np.ndarray, least: float, margin: float = 1e-6) -> np.ndarray:
    """Queries that have every vector at cosine ``least`` or more, told by the vectors' centre and radius: no false ones, some missed."""
    centre = vectors.mean(0)
    length = np.linalg.norm(centre)
    if length < 1e-9:
        return np.zeros(len(queries), bool)
    centre = centre / length
    radius = np.arccos(np.clip((vectors @ centre).min(), -1, 1))
    return np.arccos(np.clip(queries @ centre, -1, 1)) + radius <= np.arccos(least) - margin


def robust_prune(own: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Nearest first; a kept neighbour rules out those ``alpha`` times nearer to it than to the node."""
    points = vectors[candidates]
    squared = np.maximum(2 - 2 * (points @ own), 0)
    order = np.argsort(squared, kind="stable")
    candidates, points, squared = candidates[order], points[order], squared[order]
    between = np.maximum(2 - 2 * (points @ points.T), 0)
    alive, kept = np.ones(len(candidates), bool), []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * alpha * between[i] > squared
    return candidates[kept]


def build(vectors: np.ndarray, degree: int = DEGREE) -> list[np.ndarray]:
    """Adjacency of one cell: each node's nearest ones, pruned; then the reverse edges, pruned again where there are too many."""
    n = len(vectors)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    most = min(CANDIDATES, n - 1)
    forward = []
    for begin in range(0, n, 512):
        sims = vectors[begin : begin + 512] @ vectors.T
        sims[np.arange(len(sims)), np.arange(begin, begin + len(sims))] = -np.inf
        near = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        forward += [robust_prune(vectors[begin + i], row, vectors, degree) for i, row in enumerate(near)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, out in enumerate(forward):
        for j in out.tolist():
            back[j].append(i)
    both = []
    for i in range(n):
        union = np.union1d(forward[i], np.array(back[i], np.int64))
        both.append(union if len(union) <= 2 * degree else robust_prune(vectors[i], union, vectors, 2 * degree))
    return both


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(0)).argmax())


def range_search(queries: np.ndarray, vectors: np.ndarray, neighbours: np.ndarray, starts: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """Nodes found at cosine ``least`` or more, per query.

    All queries walk in step: each expands its best node not yet expanded until its ``beam``
    best are expanded. Then every found node in range is expanded until no new one is in range.
    ``neighbours`` is padded with -1.
    """
    count, n = len(queries), len(vectors)
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # the padding
    near = np.where(neighbours < 0, n, neighbours)
    full = np.vstack([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
    ids = np.full((count, beam), n, np.int64)
    sims = np.full((count, beam), -np.inf, np.float32)
    done = np.ones((count, beam), bool)
    starts = starts[:beam]
    ids[:, : len(starts)] = starts
    sims[:, : len(starts)] = queries @ vectors[starts].T
    done[:, : len(starts)] = False
    seen[:, starts] = True
    hits: list[list[np.ndarray]] = [[] for _ in range(count)]
    active = np.arange(count)
    for i, s in enumerate(starts):
        for q in np.flatnonzero(sims[:, i] >= least):
            hits[q].append(np.array([s]))
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        best = open_.argmax(1)
        live = open_[np.arange(len(active)), best] > -np.inf
        active, best = active[live], best[live]
        if not len(active):
            break
        nodes = ids[active, best]
        done[active, best] = True
        next_ = near[nodes]
        fresh = ~seen[active[:, None], next_]
        seen[active[:, None], next_] = True
        score = np.einsum("qd,qrd->qr", queries[active], full[next_], optimize=False).astype(np.float32)
        score[~fresh] = -np.inf
        for a, b in zip(*np.nonzero(score >= least)):
            hits[active[a]].append(next_[a, b : b + 1])
        all_ids = np.concatenate([ids[active], next_], axis=1)
        all_sims = np.concatenate([sims[active], score], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        sims[active] = np.take_along_axis(all_sims, top, 1)
        done[active] = np.take_along_axis(all_done, top, 1) | (sims[active] == -np.inf)
    out = []
    for q in range(count):
        found = np.concatenate(hits[q]) if hits[q] else np.zeros(0, np.int64)
        frontier = found
        while len(frontier):
            next_ = np.unique(near[frontier])
            next_ = next_[~seen[q, next_]]
            seen[q, next_] = True
            frontier = next_[vectors[next_] @ queries[q] >= least] if len(next_) else next_
            found = np.concatenate([found, frontier])
        out.append(found)
    return out
