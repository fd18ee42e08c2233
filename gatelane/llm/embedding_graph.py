"""Near-duplicate vectors by a robust-pruned flat graph.

Centres fitted on a bounded sample cut the vectors into clusters, one per ``CELL`` vectors;
beyond ``MOST_CENTRES`` of them a second codebook, fitted on what the centres leave over, cuts
every cluster further, so that the number of clusters grows with the vectors while two bounded
tables describe them all. Every vector is a member of the ``OVERLAP`` nearest clusters (the
first is its home). Each cell builds a
robust-pruned graph of its members; a node's adjacency lists from all its cells are united.
Then every vector is a query: a greedy beam search walks from the cell's medoid, and from
what it finds in range it expands until nothing new is in range. A cell that
lies inside the query's range as a whole, by its centre and radius, is counted without a walk.
Where that leads to a
vector whose home is in another cluster, the query goes on there in the next round, until no
query has a new cell to visit. Links are verified in double precision, counted at the home of
the vector found, and handed on as stars.

Clusters that are too large are dealt into cells, their pieces, by a hash; a query for such a
cluster visits all its pieces. Recall is audited after every attempt, against brute force for a random sample of
queries; below the wanted recall the search is repeated with a wider beam and more overlap,
and a recall that stays below ``REQUIRED`` is an error.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph_core as core
from .common import discard, is_empty, written
from .graph import components

SAMPLE = 20_000  # vectors the centres are fitted on, at most
CELL = 400  # vectors per centre
MOST_CENTRES = 4_096  # of each codebook
PIECE = 1_500  # members of a cell, or of a piece of it, about
PIECES = 100_000  # a cell's number is its cluster's times this, plus the piece
SCORES = 1 << 23  # distances to codewords at once in a task, at most
VISITS = 8_192  # queries that meet a cell in one task, about
OVERLAP = 3
BEAM = 40
AUDITED = 2_048  # random queries of the recall audit
REQUIRED = 0.9  # recall below which there is no answer
EXTRA = 3  # more attempts to reach it
MARGIN = 1e-5  # single precision search, double precision verification


log = logging.getLogger(__name__)


@dataclass
class Audit:
    """Found links over true ones (``pooled``), the same share averaged over the queries that have links (``mean``), and the true links."""

    pooled: float
    mean: float
    links: int

    @property
    def recall(self) -> float:
        return min(self.pooled, self.mean)


def _valid(vector: str):
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
    return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Unit rows; first divided by the largest component, so that squares neither overflow nor vanish."""
    return core.unit(rows / np.abs(rows).max(1, keepdims=True)) if len(rows) else rows


def _salt(rows: np.ndarray) -> np.ndarray:
    """A hash of every row, the same in every run."""
    odd = np.random.default_rng(1).integers(0, 1 << 62, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (rows.view(np.uint64) >> np.uint64(20)) * odd
    return ((mixed ^ (mixed >> np.uint64(29))).sum(1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _clusters(rows: np.ndarray, centres: np.ndarray, codes: np.ndarray | None, most: int) -> np.ndarray:
    """The nearest clusters of every row, nearest first: of the centres, or of centres with codewords added."""
    near = np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :most]
    if codes is None:
        return near
    out, step = [], max(1, SCORES // (near.shape[1] * len(codes)))
    for begin in range(0, len(rows), step):
        at = near[begin : begin + step]
        rest = rows[begin : begin + step, None, :] - centres[at]
        far = (rest**2).sum(2)[:, :, None] - 2 * rest @ codes.T + (codes**2).sum(1)
        far = far.reshape(len(at), -1)
        best = np.argsort(far, axis=1, kind="stable")[:, :most]
        out.append(np.take_along_axis(at, best // len(codes), 1) * len(codes) + best % len(codes))
    return np.concatenate(out)


def _members(points: DataFrame, centres: np.ndarray, codes: np.ndarray | None, overlap: int, width: int) -> DataFrame:
    """``cluster, id, copies, vector, home, salt`` for the nearest ``overlap`` clusters of every vector; ``home`` is the nearest."""
    shared = points.sparkSession.sparkContext.broadcast((centres, codes))  # MOST_CENTRES rows each at most

    def run(batches):
        centres, codes = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _scaled(_matrix(batch.column(2), width))
            near = _clusters(rows, centres, codes, overlap)
            most = near.shape[1]
            take = pa.array(np.repeat(np.arange(len(rows)), most))
            yield pa.RecordBatch.from_arrays(
                [pa.array(near.ravel()), *(batch.column(i).take(take) for i in range(3)), pa.array(np.repeat(near[:, 0], most)), pa.array(np.repeat(_salt(rows), most))],
                ["cluster", "id", "copies", "vector", "home", "salt"],
            )

    return points.select("id", "copies", "vector").mapInArrow(
        run, f"cluster bigint, id bigint, copies bigint, vector {points.schema['vector'].dataType.simpleString()}, home bigint, salt bigint"
    )


def _adjacency(members: DataFrame, width: int) -> DataFrame:
    """United lists: ``id, near``."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["id"].to_numpy())
        ids = table["id"].to_numpy()[order]
        lists = core.build(_scaled(_matrix(table["vector"], width))[order].astype(np.float32))
        return pa.table({"id": ids, "near": pa.array([ids[x] for x in lists], pa.list_(pa.int64()))})

    parts = members.select("cell", "id", "vector").groupBy("cell").applyInArrow(run, "id bigint, near array<bigint>")
    return parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _in_chunks(nodes: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``chunk``: the visits of a cell in chunks of about ``VISITS``, and its nodes, which are bounded, once for each."""
    chunks = F.ceil(F.col("count") / VISITS).cast("int")
    sizes = written(visits.groupBy("cell").count().select("cell", chunks.alias("chunks")), "chunks")
    asked = visits.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("chunks")).cast("int"))
    copies = nodes.join(sizes, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return copies, asked


def _search(nodes: DataFrame, visits: DataFrame, least: float, beam: int, width: int) -> DataFrame:
    """``kind, a, b``: 0 query and links found, 1 a star's edge, 2 query and cluster to visit."""

    def run(cell: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not cell.num_rows or not asked.num_rows:
            return empty
        order = np.argsort(cell["id"].to_numpy())
        cell = cell.take(pa.array(order))
        ids, copies, home = (cell[c].to_numpy() for c in ("id", "copies", "home"))
        here = cell["cluster"][0].as_py()
        exact = _scaled(_matrix(cell["vector"], width))
        lists = cell["near"].combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, flat)
        inside = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == flat)
        near = np.full((len(ids), max(lengths.max(), 1)), -1, np.int64)
        place = np.concatenate([np.arange(n) for n in lengths]) if len(flat) else np.zeros(0, np.int64)
        near[np.repeat(np.arange(len(ids)), lengths), place] = np.where(inside, at, -1)
        light = exact.astype(np.float32)
        start = np.array([core.medoid(light)])
        asked = asked.take(pa.array(np.argsort(asked["id"].to_numpy())))
        who, query = asked["id"].to_numpy(), _scaled(_matrix(asked["vector"], width))
        counts, stars, further = [], [], []
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        inside_all = core.covers(query, exact, least)
        if inside_all.any():
            # All nodes are hits; those of other homes are counted there.
            own = home == here
            whole, everyone = who[inside_all], int(copies[own].sum())
            itself = np.searchsorted(ids, whole)
            met = (itself < len(ids)) & (ids[np.minimum(itself, len(ids) - 1)] == whole)
            minus = np.where(met, np.where(own, copies, 0)[np.minimum(itself, len(ids) - 1)], 0)
            others = np.unique(home[~own]).tolist()
            for q, self_met, less in zip(whole.tolist(), met.tolist(), minus.tolist()):
                if self_met and len(ids) == 1:
                    continue
                counts.append((q, everyone - less))
                further += [(q, c) for c in others]
                a, b = root(ids[0].item()), root(q)
                parent[max(a, b)] = min(a, b)
            for x in ids.tolist() if counts else []:
                a, b = root(ids[0].item()), root(x)
                parent[max(a, b)] = min(a, b)
            who, query = who[~inside_all], query[~inside_all]
        for begin in range(0, len(who), 1024):
            block = slice(begin, begin + 1024)
            found = core.range_search(query[block].astype(np.float32), light, near, start, least - MARGIN, beam)
            for q, mine, hits in zip(who[block].tolist(), query[block], found):
                hits = hits[ids[hits] != q]
                hits = hits[exact[hits] @ mine >= least]
                if not len(hits):
                    continue
                # Other pieces of this cluster are visited anyway.
                own = home[hits] == here
                counts.append((q, int(copies[hits[own]].sum())))
                further += [(q, c) for c in np.unique(home[hits[~own]]).tolist()]
                for x in ids[hits].tolist():
                    a, b = root(q), root(x)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
        stars = [(root(x), x) for x in list(parent) if root(x) != x]
        rows = [(0, a, b) for a, b in counts] + [(1, a, b) for a, b in stars] + [(2, a, b) for a, b in further]
        if not rows:
            return empty
        kind, a, b = zip(*rows)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    nodes, visits = _in_chunks(nodes, visits)
    left = nodes.select("cell", "cluster", "chunk", "id", "copies", "vector", "home", "near").groupBy("cell", "chunk")
    right = visits.select("cell", "chunk", "id", "vector").groupBy("cell", "chunk")
    return left.cogroup(right).applyInArrow(run, "kind int, a bigint, b bigint")


def audit(points: DataFrame, counts: DataFrame, least: float, width: int, seed: int = 3) -> Audit:
    """Recall of link counts for ``AUDITED`` queries against brute force in blocks; what was found has no part in their choice."""
    chosen = points.orderBy(F.xxhash64("vector", F.lit(seed)), "id").limit(AUDITED)
    some = chosen.join(counts, "id", "left").select("id", "vector", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    queries, who = _scaled(_matrix(some["vector"], width)), some["id"].to_numpy()

    def run(batches):
        total = np.zeros(len(who), np.int64)
        for batch in batches:
            if batch.num_rows:
                hit = queries @ _scaled(_matrix(batch.column(2), width)).T >= least
                hit &= who[:, None] != batch.column(0).to_numpy()[None, :]
                total += hit @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(total)], ["id", "true"])

    true = points.select("id", "copies", "vector").mapInArrow(run, "id bigint, true bigint").groupBy("id").agg(F.sum("true").alias("true")).toArrow()
    wanted = dict(zip(true["id"].to_pylist(), true["true"].to_pylist()))
    shares = [(min(n, wanted[i]), wanted[i]) for i, n in zip(some["id"].to_pylist(), some["n"].to_pylist()) if wanted.get(i)]
    if not shares:
        return Audit(1.0, 1.0, 0)
    found, links = (sum(x) for x in zip(*shares))
    return Audit(found / links, sum(f / t for f, t in shares) / len(shares), links)


def link_points(points: DataFrame, width: int, least: float, beam: int, overlap: int, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` and ``(a, b)`` over distinct valid vectors ``(id, copies, vector)``."""
    total = points.count()
    sample = points.orderBy(F.xxhash64("vector", F.lit(seed)), "id").limit(SAMPLE).select("id", "vector").toArrow()
    known = _scaled(_matrix(sample["vector"], width))
    known = known[np.lexsort(known.T)]
    wanted = max(1, -(-total // CELL))
    centres, codes = core.k_means(known, min(MOST_CENTRES, len(known), wanted), seed), None
    if wanted > MOST_CENTRES:
        rest = known - centres[_clusters(known, centres, None, 1)[:, 0]]
        codes = core.mean_centres(rest, min(MOST_CENTRES, len(known), -(-wanted // len(centres))), seed)
    first = written(_members(points, centres, codes, overlap, width), "members")
    sizes = first.groupBy("cluster").agg(F.count("*").alias("n")).filter(F.col("n") > PIECE)
    # One row per large cluster: their number grows with the vectors, so it stays a table.
    pieces = written(sizes.select("cluster", F.ceil(F.col("n") / PIECE).cast("long").alias("pieces")), "large")
    cell = lambda piece: (F.col("cluster") * PIECES + piece).alias("cell")
    placed = first.join(pieces, "cluster", "left")
    members = written(placed.select(cell(F.col("salt") % F.coalesce("pieces", F.lit(1))), *first.columns), "cells")
    nodes = written(members.join(_adjacency(members, width), "id"), "nodes")

    def all_pieces(asked: DataFrame, *columns: str) -> DataFrame:
        """A query visits every piece of a cluster."""
        last = F.coalesce("pieces", F.lit(1)) - 1
        each = asked.join(pieces, "cluster", "left").select("id", *columns, "cluster", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        return each.select("id", *columns, cell(F.col("piece")))

    visits = written(all_pieces(members, "vector"), "visits")
    seen, results, spent, turn = visits.select("id", "cell"), [], [first, pieces, members, nodes, visits], 0
    while True:
        turn += 1
        result = written(_search(nodes, visits, least, beam, width), f"search-{turn}")
        results.append(result)
        more = all_pieces(result.filter("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("cluster")).distinct())
        more = written(more.join(seen, ["id", "cell"], "left_anti"), f"more-{turn}")
        spent.append(more)
        if is_empty(more):
            break
        visits = more.join(points.select("id", "vector"), "id")
        seen = seen.unionByName(more)
    found = results[0]
    for result in results[1:]:
        found = found.unionByName(result)
    counts = written(found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n")), "counts")
    edges = written(found.filter("kind = 1").select("a", "b").distinct(), "stars")
    discard(*spent, *results)
    return counts, edges


def near_duplicates(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", least: float = 0.9, wanted: float = 0.97, attempts: int = 3,
    audits: list[Audit] | None = None,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Null vectors, zero vectors and those with a null or non-finite component link with nothing.
    Shorter vectors are padded with zeros. Equal vectors link with each other and share
    what they link with; they are compared once. A row without identifier links with nothing.
    Rows that repeat an identifier are vectors of their own, with the same vector or another.

    After ``attempts`` a recall from ``REQUIRED`` to ``wanted`` is taken; below it, ``EXTRA`` more attempts
    follow and then an error. The audit of every attempt is logged and appended to ``audits``.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    # -0.0 and 0.0 are one value; equal arrays are then equal groups.
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("vector"))
    usable = rows.filter(F.col("vec_id").isNotNull() & _valid("vector")).withColumn(
        "vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind)
    )
    # A node is named by a number that the written table fixes: two different vectors may carry one identifier, and hashes may collide.
    groups = usable.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    points = written(groups.withColumn("id", F.monotonically_increasing_id()), "points")
    width = points.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    beam, overlap = BEAM, OVERLAP
    for attempt in range(1, attempts + EXTRA + 1):
        counts, edges = link_points(points, width, least, beam, overlap)
        result = audit(points, counts, least, width)
        log.info("attempt %d, beam %d, overlap %d: %s", attempt, beam, overlap, result)
        if audits is not None:
            audits.append(result)
        if result.recall >= (wanted if attempt < attempts else REQUIRED):
            break
        if attempt == attempts + EXTRA:
            raise ValueError(f"recall {result.recall:.3f} is below {REQUIRED} after {attempt} attempts: {result}")
        beam, overlap = 2 * beam, overlap + 2
    placed = components(edges)
    named = (
        points.join(counts, "id", "left")
        .join(placed.withColumnRenamed("node", "id"), "id", "left")
        .select("vector", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    )
    named = written(named, "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = written(named.join(lowest, "component").select("vector", "n_links", "component_id"), "facts")
    keyed = rows.withColumn("same", F.when(F.col("vec_id").isNotNull() & _valid("vector"), F.transform("vector", lambda x: F.when(x == 0, F.lit(0)).otherwise(x)).cast(kind)))
    joined = keyed.join(facts.withColumnRenamed("vector", "_vector"), F.col("same") == F.col("_vector"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
