"""Keyed state: the semantic cache and the in-flight load.

Both are keyed by ``(replica, model)``. A gateway keeps cache and load in its own
memory, so every replica behind a balancer has its own; the replica column carries
that over and spreads a busy model over as many tasks as there are replicas.
A single-replica log uses one constant.

The cache depends on its own earlier answers and runs key by key. The load is a clamped sum,
which has an associative summary: the sum of the steps and the lowest point on the way. A micro-batch is scanned in parts by
the two-level prefix scan, a busy key in many tasks, and only one summary per key is carried to the next batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.prefix import running_totals
from ..session import scratch_path
from ..settings import CacheOptions
from .partials import read_log, save_part, start

ENTRY = "request_id string, query string, vector array<double>, body string, ts double"
CACHE_OUT = "replica string, model string, request_id string, ts double, hit boolean, match_id string, score double, body string"
LOAD = "replica string, model string, load bigint"
LOAD_OUT = "replica string, model string, event_id bigint, load int"
SCORE_DIGITS = 9
BLOCK = 256  # requests scored by one matrix product
MOST_ENTRIES = 50_000  # of a key, where the options set no cap
OUT_ROWS = 10_000  # answers handed on at once
OUT_COLUMNS = ["replica", "model", "request_id", "ts", "hit", "match_id", "score", "body"]


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in time order.

    The size of a micro-batch is set by the source (``maxFilesPerTrigger``), so what is
    held here does not grow with the stream.
    """
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


class Memory:
    """Entries of one key with their vectors in one matrix that grows by doubling.

    An entry has a number of its own; ``changed`` and ``gone`` are the numbers of those to write and to delete.
    """

    def __init__(self, entries: list[tuple[int, tuple]]):
        self.changed: set[int] = set()
        self.gone: set[int] = set()
        self.next = max((n for n, _ in entries), default=-1) + 1
        self._load(sorted(entries, key=lambda e: e[0]))

    def _load(self, entries: list[tuple[int, tuple]]) -> None:
        self.numbers = [n for n, _ in entries]
        self.rows: list[tuple] = [e for _, e in entries]
        self.matrix = np.array([e[2] for e in self.rows], dtype=np.float64) if self.rows else None
        self.ready = np.array([e[3] is not None for e in self.rows], bool)
        self.times = np.array([e[4] for e in self.rows], np.float64)
        self.waiting = {e[0]: i for i, e in reversed(list(enumerate(self.rows))) if e[3] is None}
        self.block = None

    def ask(self, vectors: np.ndarray) -> None:
        """Score a stretch of requests by one product; entries added meanwhile are scored as they come."""
        n = len(self.rows)
        self.asked, self.block = vectors, np.empty((n + len(vectors), len(vectors)))
        if n:
            np.matmul(self.matrix[:n], vectors.T, out=self.block[:n])

    def best(self, place: int, since: float, threshold: float):
        """The answered entry nearest to the ``place``-th vector asked, among those younger than ``since``; the newest on ties."""
        n = len(self.rows)
        if self.block is None:
            self.ask(self.asked)
        if not n:
            return None
        scores = np.round(self.block[:n, place], SCORE_DIGITS)
        scores[~(self.ready[:n] & (self.times[:n] > since))] = -np.inf
        top = scores.max()
        if top == -np.inf or top < threshold:
            return None
        found = max(np.flatnonzero(scores == top).tolist(), key=lambda i: (self.times[i], self.rows[i][0]))
        return self.rows[found], float(top)

    def add(self, entry: tuple) -> None:
        n = len(self.rows)
        if self.matrix is None:
            self.matrix = np.zeros((16, len(entry[2])))
        if n >= len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        if n >= len(self.ready):
            more = max(16, n)
            self.ready = np.concatenate([self.ready, np.zeros(more, bool)])
            self.times = np.concatenate([self.times, np.zeros(more)])
        self.matrix[n], self.ready[n], self.times[n] = entry[2], entry[3] is not None, entry[4]
        if self.block is not None:
            self.block[n] = self.asked @ self.matrix[n]
        self.rows.append(entry)
        self.numbers.append(self.next)
        self.changed.add(self.next)
        self.next += 1
        if entry[3] is None:
            self.waiting.setdefault(entry[0], n)

    def answer(self, request_id: str, body: str, ts: float) -> None:
        place = self.waiting.pop(request_id, None)
        if place is not None and self.times[place] > -np.inf:
            e = self.rows[place]
            self.rows[place] = (e[0], e[1], e[2], body, ts)
            self.ready[place], self.times[place] = True, ts
            self.changed.add(self.numbers[place])

    def keep(self, since: float, most: int) -> None:
        """Forget entries not younger than ``since``, then all but the ``most`` newest (0: all stay).

        Forgotten ones get a time before all others; their rows go once they are the half.
        """
        times = self.times[: len(self.rows)]
        old = np.flatnonzero((times <= since) & (times > -np.inf))
        times[old] = -np.inf
        alive = np.flatnonzero(times > -np.inf)
        if 0 < most < len(alive):
            more = alive[np.argsort(times[alive], kind="stable")[:-most]]
            times[more] = -np.inf
            old = np.concatenate([old, more])
        for i in old.tolist():
            self.gone.add(self.numbers[i])
            self.changed.discard(self.numbers[i])
        if 2 * np.count_nonzero(times > -np.inf) < len(self.rows):
            self._load(self.alive())

    def alive(self) -> list[tuple[int, tuple]]:
        return [(n, e) for n, e, t in zip(self.numbers, self.rows, self.times) if t > -np.inf]


class CacheProcessor(StatefulProcessor):
    """Look up, then insert a pending entry on a miss; fill it when its response comes.

    Input rows have ``kind`` (``request`` or ``response``), ``request_id``, ``ts``
    (seconds), ``query``, ``vector`` and ``body``. The rows of one micro-batch are taken
    in time order. A response fills the entry of its request id, because the state of a
    key holds one model only; the table form ``operators.cache.fill`` matches by query.
    State is bounded by ``max_entries`` (without it ``MOST_ENTRIES``) and the ttl. It is a map with one record per entry, of
    which only those added, answered or forgotten in a batch are written.
    """

    def __init__(self, options: CacheOptions, expire: str = "on_read"):
        self.options, self.expire = options, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "number bigint", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        replica, model = key
        memory, out, ttl = Memory([(k[0], tuple(v)) for k, v in self.entries.iterator()]), [], self.options.ttl_seconds
        stored, most = set(memory.numbers), self.options.max_entries or MOST_ENTRIES
        batch = in_order(rows, ["ts", "kind", "request_id"])
        asks = ((batch["kind"] != "response") & batch["query"].notna() & (batch["query"] != "") & self.options.enabled).to_numpy()
        turn = np.cumsum(asks) - 1  # number of the request among those that ask
        vectors, columns = batch["vector"].to_numpy()[asks], zip(*(batch[c] for c in ("kind", "request_id", "ts", "query", "body")))
        for i, (kind, request_id, ts, query, body) in enumerate(columns):
            ts = float(ts)
            if kind == "response":
                memory.answer(request_id, body, ts)
                continue
            since, found, place = ts - ttl if ttl > 0 else -np.inf, None, turn[i] % BLOCK
            if asks[i]:
                if place == 0:
                    memory.ask(np.array(list(vectors[turn[i] : turn[i] + BLOCK]), dtype=np.float64))
                found = memory.best(place, since if self.expire == "on_read" else -np.inf, self.options.threshold)
                if found is None:
                    memory.keep(since, 0)
                    memory.add((request_id, query, [float(x) for x in vectors[turn[i]]], None, ts))
                    memory.keep(-np.inf, most)
            entry, score = found or ((None,) * 5, None)
            out.append((replica, model, request_id, ts, found is not None, entry[0], score, entry[3]))
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=OUT_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=OUT_COLUMNS)
        for number in memory.gone & stored:
            self.entries.removeKey((number,))
        for number, entry in memory.alive():
            if number in memory.changed:
                self.entries.updateValue((number,), entry)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Preload complete entries."""
        rows = zip(*(initialState[c] for c in ("request_id", "query", "vector", "body", "ts")))
        first = max((k[0] for k in self.entries.keys()), default=-1) + 1
        for number, (request_id, query, vector, body, ts) in enumerate(rows, first):
            self.entries.updateValue((number,), (request_id, query, [float(x) for x in vector], body, float(ts)))

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, options: CacheOptions, preload: DataFrame | None = None, expire: str = "on_read") -> DataFrame:
    """Decide every request of a stream of request and response events.

    ``preload`` holds complete entries ``(replica, model, request_id, query, vector, body, ts)``.
    """
    initial = None if preload is None else preload.groupBy("replica", "model")
    return events.groupBy("replica", "model").transformWithStateInPandas(
        CacheProcessor(options, expire), CACHE_OUT, "append", "None", initialState=initial
    )


def log_load(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, bucket_seconds: int = 3600) -> StreamingQuery:
    """In-flight load after every event ``(replica, model, event_id, ts, step)``, as batches below ``path/load``.

    +1 and -1 steps, never below zero. Events of a batch are taken in the order of time and identifier; a batch continues from
    ``path/state``, the loads after the batch before it, one row per key.
    """
    keys = ["replica", "model"]

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_log(spark, f"{path}/state", spark.createDataFrame([], LOAD)).filter(F.col("batch_id") == batch_id - 1).select(
            F.col("replica").alias("_replica"), F.col("model").alias("_model"), F.col("load").alias("_carry")
        )
        own = F.col("replica").eqNullSafe(F.col("_replica")) & F.col("model").eqNullSafe(F.col("_model"))
        scanned = running_totals(batch, keys, ["ts", "event_id"], F.col("step"), F.floor(F.col("ts") / bucket_seconds), F.floor("ts"))
        carry = F.coalesce("_carry", F.lit(0))
        load = carry + F.col("running") - F.least(F.lit(0), carry + F.col("running_min"))
        save_part(scanned.join(before, own, "left").select(*keys, "event_id", load.cast("int").alias("load")), f"{path}/load", batch_id)
        # The summary of a key's batch: the whole sum, and the lowest point on the way.
        summary = scanned.groupBy(*keys).agg(F.sum("step").alias("_sum"), F.min("running_min").alias("_low"))
        lifted = carry + F.coalesce("_sum", F.lit(0)) - F.least(F.lit(0), carry + F.coalesce("_low", F.lit(0)))
        after = summary.join(before, own, "full").select(
            F.coalesce("replica", "_replica").alias("replica"), F.coalesce("model", "_model").alias("model"), lifted.cast("bigint").alias("load")
        )
        save_part(after, f"{path}/state", batch_id)

    return start(events, save, checkpoint, available_now)


def collect_load(events: DataFrame, name: str = "load") -> DataFrame:
    """``log_load`` over what is available now."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, name)
    log_load(events, path, path + "-checkpoint").awaitTermination()
    return read_log(spark, f"{path}/load", spark.createDataFrame([], LOAD_OUT)).drop("batch_id")
