"""Semantic cache as table operations: lookup, fill and retention.

``lookup`` answers requests from a given table of entries. The cache whose content depends
on its own earlier decisions is the keyed stream in ``streaming.state``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds
from ..settings import CacheOptions
from .prefix import running_totals
from .similarity import BLOCK_ROWS, best_match


def unexpired(entries: DataFrame, ts: Column, now: Column, ttl: int) -> DataFrame:
    """Entries younger than ``ttl`` seconds at ``now``; a ttl of zero keeps all."""
    return entries if ttl <= 0 else entries.filter(now - ts < ttl)


def count_expired(entries: DataFrame, ts: Column, now: Column, ttl: int) -> DataFrame:
    """How many entries a read would find expired, without dropping them."""
    expired = (now - ts >= ttl) if ttl > 0 else F.lit(False)
    return entries.agg(F.count_if(expired).alias("n_expired"), F.count("*").alias("n_entries"))


def keep_newest(entries: DataFrame, ts: str, ident: str, max_entries: int) -> DataFrame:
    """The newest ``max_entries`` entries, pending ones included; zero keeps all.

    A top-k: every task keeps its own newest rows and only those are merged.
    """
    if max_entries <= 0:
        return entries
    return entries.orderBy(F.desc(ts), F.desc(ident)).limit(max_entries)


def lookup(
    requests: DataFrame,
    entries: DataFrame,
    options: CacheOptions,
    request_id: str,
    entry_id: str,
    model: str,
    vector: str,
    request_ts: str,
    response_ts: str,
    expire: str = "on_read",
    pivots: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``hit``, ``match_id`` and ``score`` to each request.

    An entry counts once its response is there (``response_ts`` not after the
    request) and only for the same requested model. ``expire="on_write"`` serves
    entries past their ttl, as a cache does that only cleans up when it writes;
    the default does not. With ``max_entries`` a request sees only that many entries, of
    all models: those answered last before it (of equal times, those with the higher id).
    Equal scores go to the newest entry.
    """
    if not options.enabled:
        kind = entries.schema[entry_id].dataType.simpleString()
        return requests.withColumn("hit", F.lit(False)).withColumn("match_id", F.lit(None).cast(kind)).withColumn("score", F.lit(None).cast("double"))
    ready, asking, places = entries.filter(F.col(response_ts).isNotNull()), requests, {}
    if options.max_entries > 0:
        asking, ready = _places(requests, ready, request_id, entry_id, request_ts, response_ts)
        places = {"latest": options.max_entries, "query_place": F.col("_place"), "entry_place": F.col("_place")}
    found = best_match(
        asking, ready, request_id, entry_id, vector, vector, [model],
        seconds(asking, request_ts), seconds(ready, response_ts),
        ttl=options.ttl_seconds if options.ttl_seconds > 0 and expire == "on_read" else None,
        min_score=options.threshold, prefer="newest", pivots=pivots, block_rows=block_rows, **places,
    )
    return requests.join(found, request_id, "left").withColumn("hit", F.col("match_id").isNotNull())


def _places(requests: DataFrame, entries: DataFrame, request_id: str, entry_id: str, request_ts: str, response_ts: str, bucket_seconds: int = 60):
    """Both sides with ``_place``: an entry's number in time order, and the number of entries up to a request."""
    side = lambda df, ident, ts, step: df.select(
        F.lit(step).alias("_step"), F.col(ident).cast("string").alias("_name"), F.col(ident).alias("_of"), seconds(df, ts).cast("double").alias("_at")
    )
    marks = side(entries, entry_id, response_ts, 1).select("_step", "_name", "_at", F.col("_of").alias("_tie")).unionByName(
        side(requests, request_id, request_ts, 0).select("_step", "_name", "_at", F.lit(None).cast(entries.schema[entry_id].dataType).alias("_tie"))
    ).withColumn("_all", F.lit(0))
    scanned = running_totals(marks, ["_all"], ["_at", F.desc("_step"), "_tie", "_name"], F.col("_step"), F.floor(F.col("_at") / bucket_seconds), F.floor("_at"))
    numbered = scanned.select("_step", "_name", F.col("running").alias("_place"))
    give = lambda df, ident, step: df.join(
        numbered.filter(F.col("_step") == step).drop("_step"), F.col(ident).cast("string") == F.col("_name")
    ).drop("_name")
    return give(requests, request_id, 0), give(entries, entry_id, 1)


def fill(
    pending: DataFrame, responses: DataFrame, query: str, pending_id: str, response_id: str,
    pending_ts: str, response_ts: str, bucket_seconds: int = 3600,
) -> DataFrame:
    """Which pending entry each response completes: ``(pending_id, response_id, response_ts)``.

    A response goes to the oldest pending entry with the same query text; the model
    is not compared. A response that finds no pending entry is lost. Per query this
    is a queue: with pending as +1 and responses as -1, a response is lost exactly
    when the running sum reaches a new low below zero, and the k-th response that is
    not lost completes the k-th pending entry.
    """
    side = lambda df, ident, ts, step: df.select(
        F.sha2(F.col(query).cast("string"), 256).alias("_q"), F.col(ident).alias("_id"),
        F.col(ts).alias("_ts"), F.lit(step).alias("_step"),
    )
    events = side(pending, pending_id, pending_ts, 1).unionByName(side(responses, response_id, response_ts, -1))
    bucket = F.floor(seconds(events, "_ts") / bucket_seconds)
    scanned = running_totals(events, ["_q"], ["_ts", F.desc("_step"), "_id"], F.col("_step"), bucket, F.floor(seconds(events, "_ts")))
    opens = F.col("_step") > 0
    low = F.least(F.lit(0), F.coalesce("running_min_before", F.lit(0)))
    is_lost = ~opens & (F.col("running") < low)
    n_pending = (F.col("position") + F.col("running")) / 2
    n_served = (F.col("position") - F.col("running")) / 2 + F.least(F.lit(0), F.col("running_min"))
    ranked = scanned.filter(~is_lost).select("_q", "_id", "_ts", opens.alias("_opens"), F.when(opens, n_pending).otherwise(n_served).cast("bigint").alias("_k"))
    # The k-th entry and the k-th served response of a query meet in one group of two.
    met = ranked.groupBy("_q", "_k").agg(
        F.max(F.when(F.col("_opens"), F.col("_id"))).alias(pending_id),
        F.max(F.when(~F.col("_opens"), F.col("_id"))).alias(response_id),
        F.max(F.when(~F.col("_opens"), F.col("_ts"))).alias(response_ts),
    )
    return met.filter(F.col(pending_id).isNotNull() & F.col(response_id).isNotNull()).drop("_q", "_k")
