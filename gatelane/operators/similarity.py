"""Best-match search, linear heads and centroids over vector columns.

The matching join never materialises pairs. Both sides are cut into blocks of bounded
size per cell, each block pair is searched by matrix products of tiles inside a
task, and only the best candidate per query and block leaves the task. A hot cell
therefore becomes many equal blocks instead of one large group. A row is copied once per
block of the other side, so blocks grow with the table, up to ``GROUP_ROWS``, before their number does.

Cells are chosen so that a query meets only entries that can still matter:

* equality columns (for the cache: the model);
* time windows, when entries expire: an entry lives in one window, a query looks
  at its own and the previous window;
* place windows, when only the latest entries count: a query looks at the at most two windows
  that its latest entries lie in;
* pivots, when there are many entries and no expiry: each entry belongs to its
  nearest pivot, and the triangle inequality on angles rules out whole cells. The rule is exact for unit vectors.
  Neighbouring cells share a bin; a query is sent once to every bin with a cell that can matter, and the task skips the
  other cells of the bin. A score floor gives the bound; without one a first pass answers every query from the bin of its
  own nearest pivot, and that answer is the bound for a second pass over the other bins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 2048
BLOCKS = 16  # blocks of a side before these grow beyond BLOCK_ROWS
BINS = 40  # bins of pivot cells, as long as none holds more than GROUP_ROWS on average
GROUP_ROWS = 1 << 15  # rows of a side that one task holds at most
TILE = 2048  # queries multiplied at once
MAX_CLASSES = 4096
SCORE_DIGITS = 9  # equal vectors must tie whatever the shape of their block
ANGLE_SLACK = 3e-3  # unit vectors of single precision have angles that are off by up to 1e-3


def as_matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Row-major float64 matrix from a list array without nulls."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    if rows == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1)


# --------------------------------------------------------------------------- heads
class LinearHead:
    """Dense layer + softmax + argmax; the weights travel with the closure.

    The weight matrix has ``classes x dim`` numbers and is refused above
    ``MAX_CLASSES`` classes; ``best_match`` covers larger label sets.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray | None = None, scale: float = 1.0):
        self.weights = np.asarray(weights, dtype=np.float64) * scale
        self.bias = np.zeros(len(self.weights)) if bias is None else np.asarray(bias, dtype=np.float64)
        if len(self.weights) > MAX_CLASSES:
            raise ValueError(f"a head holds at most {MAX_CLASSES} classes; use best_match instead")

    @classmethod
    def from_centroids(cls, centroids: DataFrame, label: str = "label", vector: str = "centroid", scale: float = 1.0):
        """Head whose weights are the unit centroids; ``label`` must be 0..n-1."""
        rows = centroids.select(label, vector).orderBy(label).take(MAX_CLASSES + 1)
        if [r[0] for r in rows] != list(range(len(rows))):
            raise ValueError("centroid labels must be dense and start at 0")
        weights = np.array([r[1] for r in rows], dtype=np.float64)
        return cls(weights / np.linalg.norm(weights, axis=1, keepdims=True), scale=scale)

    def score(self, vector: Column) -> Column:
        """``struct<class, confidence>``; NULL for a NULL vector. The last class wins ties."""
        weights, bias = self.weights, self.bias
        out = pa.struct([("class", pa.int32()), ("confidence", pa.float64())])

        @F.arrow_udf("struct<class:int,confidence:double>")
        def head(v: pa.Array) -> pa.Array:
            valid = ~np.asarray(v.is_null())
            cls, conf = np.zeros(len(v), np.int32), np.zeros(len(v))
            if valid.any():
                logits = as_matrix(v.drop_null()) @ weights.T + bias
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                best = logits.shape[1] - 1 - np.argmax(logits[:, ::-1], axis=1)
                cls[valid] = best
                conf[valid] = odds[np.arange(len(best)), best] / odds.sum(axis=1)
            return pa.StructArray.from_arrays(
                [pa.array(cls), pa.array(conf)], fields=list(out), mask=pa.array(~valid)
            )

        return head(vector)


def centroids(df: DataFrame, label: str, vector: str, order: str | None = None, first: int | None = None) -> DataFrame:
    """Mean vector per label, optionally over the first ``first`` rows by ``order``.

    With ``first`` the ranking is limited on the map side, so a hot label sends
    only a handful of rows. Without it the mean is a plain partial aggregate.
    """
    if first:
        rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
        df = df.select(label, vector, rank.alias("_rank")).filter(F.col("_rank") <= first)
    parts = df.select(label, F.posexplode(vector).alias("_dim", "_x"))
    means = parts.groupBy(label, "_dim").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    # One entry per dimension: the group is bounded by the vector length.
    ordered = F.array_sort(F.collect_list(F.struct("_dim", "_mean")))
    return means.groupBy(label).agg(F.transform(ordered, lambda s: s["_mean"]).alias("centroid"))


# --------------------------------------------------------------------------- blocks
def _pivot_matrix(entries: DataFrame, pivots: int) -> np.ndarray:
    """A bounded, hash-ordered choice of entry vectors, used only to lay out cells."""
    rows = entries.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(pivots).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def _with_entry_cell(entries: DataFrame, pivots: np.ndarray, bins: np.ndarray | None = None) -> DataFrame:
    """Add ``_cell``, the nearest pivot, ``_bin``, the bin of that, and ``_angle`` to it."""
    bins = np.zeros(len(pivots), np.int32) if bins is None else bins

    @F.arrow_udf("struct<cell:int,bin:int,angle:double>")
    def nearest(v: pa.Array) -> pa.Array:
        scores = as_matrix(v) @ pivots.T if len(v) else np.zeros((0, 1))
        cell = scores.argmax(axis=1) if len(v) else np.zeros(0, np.int64)
        angle = np.arccos(np.clip(scores[np.arange(len(cell)), cell], -1, 1))
        return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(bins[cell]), pa.array(angle)], ["cell", "bin", "angle"])

    return entries.withColumn("_n", nearest("_v")).select("*", *(F.col(f"_n.{c}").alias(f"_{c}") for c in ("cell", "bin", "angle"))).drop("_n")


def _layout(entries: DataFrame, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pivots, the radius of each cell (-1: empty) and its bin: neighbouring cells, the cells nearest to one of the first pivots."""
    matrix = _pivot_matrix(entries, pivots)
    radius, rows = np.full(len(matrix), -1.0), 0
    if len(matrix):
        for row in _with_entry_cell(entries, matrix).groupBy("_cell").agg(F.max("_angle").alias("r"), F.count("*").alias("n")).collect():  # one row per pivot
            radius[row["_cell"]], rows = row["r"], rows + row["n"]
    first = matrix[: max(BINS, math.ceil(rows / GROUP_ROWS))]
    return matrix, radius, (matrix @ first.T).argmax(axis=1).astype(np.int32) if len(matrix) else np.zeros(0, np.int32)


def _reached(v: np.ndarray, low: np.ndarray, pivots: np.ndarray, radius: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Per vector and bin: whether a cell of the bin may hold an entry that scores ``low`` or more."""
    out = np.zeros((len(v), int(bins.max()) + 1), bool)
    of = np.eye(out.shape[1], dtype=np.float32)[bins]
    for a in range(0, len(v), TILE):
        some = slice(a, a + TILE)
        reach = radius[None, :] + np.arccos(np.clip(low[some] - 10.0**-SCORE_DIGITS, -1, 1))[:, None] + ANGLE_SLACK
        keep = (np.arccos(np.clip(v[some] @ pivots.T, -1, 1)) <= reach) & (radius >= 0)[None, :]
        out[some] = keep.astype(np.float32) @ of > 0
    return out


def _query_bins(vector: Column, pivots: np.ndarray, radius: np.ndarray, bins: np.ndarray, floor: float, pivots_count: bool) -> Column:
    @F.arrow_udf("array<int>")
    def reached(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        v = as_matrix(v)
        # A pivot is itself an entry: its score is a floor for the best match.
        low = np.maximum(floor, (v @ pivots.T).max(axis=1)) if pivots_count else np.full(len(v), floor)
        return pa.array([np.flatnonzero(row).astype(np.int32) for row in _reached(v, low, pivots, radius, bins)], pa.list_(pa.int32()))

    return reached(vector)


def _better_bins(pivots: np.ndarray, radius: np.ndarray, bins: np.ndarray) -> Column:
    """Bins other than the query's own that may hold a better entry than ``_low``, the best one known (null: none)."""

    @F.arrow_udf("array<int>")
    def reached(v: pa.Array, known: pa.Array, own: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        low = known.fill_null(-1.0).to_numpy(zero_copy_only=False)
        keep = _reached(as_matrix(v), low, pivots, radius, bins)
        keep[np.arange(len(keep)), own.to_numpy(zero_copy_only=False)] = False
        return pa.array([np.flatnonzero(row).astype(np.int32) for row in keep], pa.list_(pa.int32()))

    return reached("_v", "_low", "_bin")


def _blocked(queries: DataFrame, entries: DataFrame, cell: list[str], kernel, out: str, block_rows: int) -> DataFrame:
    """Run ``kernel`` on every pair of blocks that share a cell."""
    def blocks(rows: Column) -> Column:
        most = F.greatest(F.ceil(rows / max(GROUP_ROWS, block_rows)), F.lit(BLOCKS))
        return F.greatest(F.least(F.ceil(rows / block_rows), most), F.lit(1)).cast("int")

    def sized(df: DataFrame) -> DataFrame:
        """Number of query and entry blocks in the row's cell."""
        if not cell:  # one cell: its two counts are constants of the plan
            return df.withColumn("_nq", blocks(F.lit(totals[0]))).withColumn("_ne", blocks(F.lit(totals[1])))
        return df.join(sizes, cell)

    if cell:
        count = lambda df, name: df.groupBy(*cell).agg(blocks(F.count("*")).alias(name))
        sizes = count(queries, "_nq").join(count(entries, "_ne"), cell)
    else:
        totals = queries.count(), entries.count()
    left = (
        sized(queries)
        .withColumn("_bq", F.pmod(F.xxhash64("_id"), F.col("_nq")).cast("int"))
        .withColumn("_be", F.explode(F.sequence(F.lit(0), F.col("_ne") - 1)))
        .drop("_nq", "_ne")
    )
    right = (
        sized(entries)
        .withColumn("_be", F.pmod(F.xxhash64("_id"), F.col("_ne")).cast("int"))
        .withColumn("_bq", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .drop("_nq", "_ne")
    )
    group = [*cell, "_bq", "_be"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(kernel, out)


def _balls(e: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries sorted by cell: where each cell begins and ends, its centre and the largest angle from that."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
    centres, radius = np.empty((len(edges) - 1, e.shape[1])), np.empty(len(edges) - 1)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        mean = e[a:b].mean(axis=0)
        centres[i] = mean / max(np.linalg.norm(mean), 1e-9)
        radius[i] = np.arccos(np.clip((e[a:b] @ centres[i]).min(), -1, 1))
    return edges, centres, radius


def _prepare(df: DataFrame, ident: str, vector: str, on: list[str], ts: Column | None, extra: dict[str, Column]) -> DataFrame:
    kind = df.schema[vector].dataType.simpleString()
    cols = [F.col(ident).alias("_id"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("_v")]
    cols += [F.col(c).alias(f"_on_{c}") for c in on]
    cols += [(F.lit(0.0) if ts is None else ts.cast("double")).alias("_t")]
    cols += [] if "_p" in extra else [F.lit(0).cast("bigint").alias("_p")]
    cols += [c.alias(n) for n, c in extra.items()]
    return df.select(*cols).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull())


def _times_ok(q_t, e_t, ttl: float | None):
    """Which entries a query may see."""
    age = q_t[:, None] - e_t[None, :]
    return (age >= 0) & (age < ttl) if ttl else age >= 0


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _cells(q: DataFrame, e: DataFrame, on: list[str], timed: bool, ttl: float | None, pivots: int, floor: float | None, own_counts: bool, latest: int = 0, block_rows: int = BLOCK_ROWS):
    """Add cell columns to both sides and name them."""
    cell = [f"_on_{c}" for c in on]
    if timed and ttl:
        window = F.floor(F.col("_t") / ttl)
        e = e.withColumn("_w", window)
        q = q.withColumn("_w", F.explode(F.array(window, window - 1)))
        cell.append("_w")
    if latest:
        width = max(latest, block_rows)  # so a query's latest entries lie in one window or two
        at = lambda place: F.floor(place / width)
        e = e.withColumn("_pw", at(F.col("_p")))
        q = q.withColumn("_pw", F.explode(F.array_distinct(F.array(at(F.col("_p")), at(F.col("_p") - latest + 1)))))
        cell.append("_pw")
    if pivots:
        matrix, radius, bins = _layout(e, pivots)
        if len(matrix):
            e = _with_entry_cell(e, matrix, bins).drop("_angle")
            # Every pivot is a candidate of every query, unless keys, times or the query itself rule it out.
            unconditional = not on and not timed and own_counts
            q = q.withColumn("_bin", F.explode(_query_bins(F.col("_v"), matrix, radius, bins, -1.0 if floor is None else floor, unconditional)))
            cell.append("_bin")
    return q, e, cell


def _two_passes(q: DataFrame, e: DataFrame, cell: list[str], pivots: int, search) -> DataFrame:
    """What ``search(q, e, cell)`` finds, in two passes over bins of pivot cells."""
    matrix, radius, bins = _layout(e, pivots)
    if not len(matrix):
        return search(q, e, cell)
    entries, cell = _with_entry_cell(e, matrix, bins).drop("_angle"), [*cell, "_bin"]
    near = _with_entry_cell(q, matrix, bins).drop("_angle", "_cell")
    first = cut_lineage(search(near, entries, cell), "nearest-bin")
    known = first.groupBy("_id").agg(F.max("_s").alias("_low"))
    bounded = near.join(known, "_id", "left")
    others = bounded.withColumn("_bin", F.explode(_better_bins(matrix, radius, bins)))
    return first.unionByName(search(others, entries, cell))


def root_pivots(rows: DataFrame, least: int = 0) -> int:
    """A number of pivots that grows with the square root of the rows, so that cells do too.

    0, no pivots, for at most ``least`` rows: few blocks meet faster without cells.
    """
    count = rows.count()
    return math.isqrt(max(count - 1, 0)) + 1 if count > least else 0


def best_match(
    queries: DataFrame,
    entries: DataFrame,
    query_id: str,
    entry_id: str,
    query_vector: str = "embedding",
    entry_vector: str = "embedding",
    on: list[str] | None = None,
    query_time: Column | None = None,
    entry_time: Column | None = None,
    ttl: float | None = None,
    min_score: float | None = None,
    prefer: str = "first",
    exclude_self: bool = False,
    pivots: int = 0,
    block_rows: int = BLOCK_ROWS,
    latest: int = 0,
    query_place: Column | None = None,
    entry_place: Column | None = None,
) -> DataFrame:
    """Best entry per query by dot product: ``(query id, match_id, score)``.

    Identifiers are of any type with an order. ``prefer`` breaks ties: ``first`` takes the
    lowest entry id, ``newest`` the latest entry time and then the highest id. Scores tie when
    they agree to nine digits; ``min_score`` is compared with the exact score. Queries
    without any candidate at or above it do not appear. Times are seconds. Pivots need
    unit vectors and change nothing but the layout (``root_pivots`` fits large tables); with them, or
    without any cell column, counts and bounds are computed by Spark when this is called.
    With ``latest`` a query sees only entries whose ``entry_place`` is among the
    ``latest`` last ones up to its own ``query_place``.
    """
    on, timed = on or [], query_time is not None
    place = lambda c: {} if c is None else {"_p": c.cast("bigint")}
    q = _prepare(queries, query_id, query_vector, on, query_time, place(query_place))
    e = _prepare(entries, entry_id, entry_vector, on, entry_time, place(entry_place))
    out = f"_id {q.schema['_id'].dataType.simpleString()}, _m {e.schema['_id'].dataType.simpleString()}, _s double, _mt double"
    bounded = bool(pivots) and min_score is None
    q, e, cell = _cells(q, e, on, timed, ttl, 0 if bounded else pivots, min_score, not exclude_self and not latest, latest, block_rows)
    newest = prefer == "newest"

    def kernel(qt: pa.Table, et: pa.Table) -> pa.Table:
        by = [("_t", "descending"), ("_id", "descending")] if newest else [("_id", "ascending")]
        et = et.take(pc.sort_indices(et, sort_keys=by))
        qt = qt.take(pc.sort_indices(qt, sort_keys=[("_t", "ascending")]))
        wish = np.arange(et.num_rows)  # place in the order that breaks ties
        if "_cell" in et.column_names:
            wish = np.argsort(_column(et, "_cell"), kind="stable")
            et = et.take(pa.array(wish))
        top, best = np.full(qt.num_rows, -np.inf), np.zeros(qt.num_rows, np.int64)
        if qt.num_rows and et.num_rows:
            _search(qt, et, wish, top, best)
        keep = np.flatnonzero(top > -np.inf)
        chosen = pa.array(best[keep])
        return pa.table({"_id": qt["_id"].take(pa.array(keep)), "_m": et["_id"].take(chosen), "_s": top[keep], "_mt": _column(et, "_t")[best[keep]]})

    def _search(qt: pa.Table, et: pa.Table, wish: np.ndarray, top: np.ndarray, best: np.ndarray) -> None:
        """Set ``top`` and ``best``, score and place of each query's best entry."""
        q, e, q_t, e_t, q_p, e_p = (f(t) for f in (lambda t: as_matrix(t["_v"]), lambda t: _column(t, "_t"), lambda t: _column(t, "_p")) for t in (qt, et))
        low = np.full(len(q), -np.inf if min_score is None else min_score)
        if "_low" in qt.column_names:
            low = np.fmax(low, _column(qt, "_low"))
        mine = pc.index_in(qt["_id"], value_set=et["_id"].combine_chunks()).fill_null(-1).to_numpy() if exclude_self else None

        def visit(some: np.ndarray, a: int, b: int) -> None:
            at = np.arange(a, b)
            if timed:
                at = at[e_t[a:b] <= q_t[some].max()]
                if not len(at):
                    return
            exact = q[some] @ e[at].T
            if timed and (ttl or e_t[at].max() > q_t[some].min()):
                exact[~_times_ok(q_t[some], e_t[at], ttl)] = -np.inf
            if latest:
                exact[q_p[some][:, None] - e_p[at][None, :] >= latest] = -np.inf
            if exclude_self:
                own = np.searchsorted(at, mine[some])
                hit = np.flatnonzero((own < len(at)) & (at[np.minimum(own, len(at) - 1)] == mine[some]))
                exact[hit, own[hit]] = -np.inf
            high = exact.max(axis=1)
            hope = np.flatnonzero((high > -np.inf) & (np.round(high, SCORE_DIGITS) >= np.maximum(top[some], np.round(low[some], SCORE_DIGITS))))
            if not len(hope):
                return
            exact, some = exact[hope], some[hope]
            scores = np.round(exact, SCORE_DIGITS)
            if min_score is not None:
                scores[exact < min_score] = -np.inf
            place = scores.argmax(axis=1)
            value, place = scores[np.arange(len(some)), place], at[place]
            better = (value > top[some]) | ((value == top[some]) & (wish[place] < wish[best[some]]) & (value > -np.inf))
            top[some[better]], best[some[better]] = value[better], place[better]

        if "_cell" in et.column_names:
            edges, centres, radius = _balls(e, _column(et, "_cell"))
        for begin in range(0, len(q), TILE):
            some = np.arange(begin, min(begin + TILE, len(q)))
            if "_cell" not in et.column_names:
                for a in range(0, len(e), TILE):
                    visit(some, a, min(a + TILE, len(e)))
                continue
            angles = np.arccos(np.clip(q[some] @ centres.T, -1, 1)) - radius[None, :]
            home = angles.argmin(axis=1)
            for i in np.unique(home):  # a near answer first: it rules out other cells
                visit(some[home == i], edges[i], edges[i + 1])
            for i in range(len(radius)):
                bound = np.maximum(low[some], top[some])
                near = (home != i) & (angles[:, i] <= np.arccos(np.clip(bound - 10.0**-SCORE_DIGITS, -1, 1)) + ANGLE_SLACK)
                if near.any():
                    visit(some[near], edges[i], edges[i + 1])

    # Bins are few: their blocks are as large as a task may hold, so that a row meets one or two.
    search = lambda q, e, cell: _blocked(q, e, cell, kernel, out, GROUP_ROWS if "_bin" in cell else block_rows)
    found = _two_passes(q, e, cell, pivots, search) if bounded else search(q, e, cell)
    pair = F.struct("_m", "_s")
    best = F.max_by(pair, F.struct("_s", "_mt", "_m")) if newest else F.min_by(pair, F.struct(-F.col("_s"), F.col("_m")))
    return found.groupBy("_id").agg(best.alias("_b")).select(
        F.col("_id").alias(query_id), F.col("_b._m").alias("match_id"), F.col("_b._s").alias("score")
    )


class NearestCentroid:
    """Most similar of a small set of named vectors; they travel with the closure, no row is moved.

    Refused above ``MAX_CLASSES`` vectors; use ``best_match`` for larger sets.
    """

    def __init__(self, named: DataFrame, label: str = "label", vector: str = "centroid"):
        rows = named.select(label, vector).orderBy(label).take(MAX_CLASSES + 1)
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"at most {MAX_CLASSES} vectors travel with a closure; use best_match instead")
        self.labels, self.matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
        self.kind = named.schema[label].dataType.simpleString()

    def match(self, vector: Column) -> Column:
        """``struct<label, similarity>``, the lowest label on ties; NULL for a NULL vector or without any centroid."""
        labels, matrix = self.labels, self.matrix

        @F.arrow_udf("struct<place:int,similarity:double>")
        def nearest(v: pa.Array) -> pa.Array:
            valid = ~np.asarray(v.is_null()) & bool(labels)
            place, top = np.zeros(len(v), np.int32), np.zeros(len(v))
            if valid.any():
                scores = np.round(as_matrix(v.drop_null()) @ matrix.T, SCORE_DIGITS)
                best = scores.argmax(axis=1)
                place[valid], top[valid] = best, scores[np.arange(len(best)), best]
            return pa.StructArray.from_arrays([pa.array(place), pa.array(top)], ["place", "similarity"], mask=pa.array(~valid))

        found = nearest(vector)
        names = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast(f"array<{self.kind}>")
        return F.when(found.isNotNull(), F.struct(F.get(names, found["place"]).alias("label"), found["similarity"].alias("similarity")))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, left: str, right: str, ident: str, vector: str) -> DataFrame:
    """Cosine of each given pair; a missing vector gives the failure score -1."""
    from ..functions.vectors import cosine

    a = vectors.select(F.col(ident).alias(left), F.col(vector).alias("_a"))
    b = vectors.select(F.col(ident).alias(right), F.col(vector).alias("_b"))
    scored = pairs.join(a, left, "left").join(b, right, "left")
    return scored.withColumn("similarity", F.coalesce(cosine(F.col("_a"), F.col("_b")), F.lit(-1.0))).drop("_a", "_b")
