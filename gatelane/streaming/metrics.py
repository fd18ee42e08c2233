"""Streaming counters, panes and pairing.

Sliding rates are kept as panes of one slide; the windows are made from the panes at
read time, so an event updates one state row and not one per overlapping window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds
from ..operators.metrics import bucket_index

# --- Fixed values: dashboard window and refresh, in seconds -------------------
RATE_WINDOW, REFRESH = 300, 10
# ------------------------------------------------------------------------------


def running_counters(increments: DataFrame) -> DataFrame:
    """Running totals of series increments; use update mode."""
    return increments.groupBy("name", "label_1", "label_2").agg(F.sum("amount").alias("value"))


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def pane_sums(stream: DataFrame, ts: str, keys: list[str], value: Column, slide: int = REFRESH, delay: str = "10 minutes") -> DataFrame:
    """Sums per pane and key; rows later than ``delay`` are dropped and counted by the engine."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    sums = timed.groupBy(F.window("_ts", f"{slide} seconds").alias("_w"), *keys).agg(F.sum(value).alias("value"))
    return sums.select(F.unix_seconds("_w.start").alias("pane"), *keys, "value")


def pane_buckets(stream: DataFrame, ts: str, keys: list[str], latency: Column, slide: int = REFRESH, delay: str = "10 minutes") -> DataFrame:
    """Latency bucket counts per pane and key, the state behind a windowed quantile."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counts = timed.groupBy(
        F.window("_ts", f"{slide} seconds").alias("_w"), *keys, bucket_index(latency).alias("bucket")
    ).agg(F.count("*").alias("n"))
    return counts.select(F.unix_seconds("_w.start").alias("pane"), *keys, "bucket", "n")


def pair_stream(
    requests: DataFrame, responses: DataFrame, request_id: str, request_ts: str, response_ts: str,
    delay: str = "10 minutes", within: str = "10 minutes", how: str = "leftOuter",
) -> DataFrame:
    """Stream-stream join of requests and responses on the request id.

    A response counts up to ``within`` after its request; state is dropped once both
    watermarks are past that. Requests without an id are left out: they never pair.
    """
    left = (
        requests.filter(F.coalesce(F.col(request_id), F.lit("")) != "")
        .withColumn(request_ts, F.col(request_ts).cast("timestamp")).withWatermark(request_ts, delay).alias("q")
    )
    right = (
        responses.withColumn(response_ts, F.col(response_ts).cast("timestamp"))
        .withColumnRenamed(request_id, "_response_id").withWatermark(response_ts, delay).alias("r")
    )
    condition = (
        (F.col(f"q.{request_id}") == F.col("r._response_id"))
        & (F.col(f"r.{response_ts}") >= F.col(f"q.{request_ts}"))
        & (F.col(f"r.{response_ts}") <= F.col(f"q.{request_ts}") + F.expr(f"interval {within}"))
    )
    joined = left.join(right, condition, how)
    return joined.withColumn("no_response", F.col("_response_id").isNull()).drop("_response_id")


def withheld(
    requests: DataFrame, responses: DataFrame, told: DataFrame, request_id: str, request_ts: str, response_ts: str, within: str = "10 minutes",
) -> DataFrame:
    """Closing step of ``pair_stream``: the requests that are not in ``told``, as tables, once no more rows come.

    A left outer stream join keeps a request without response until both watermarks have passed; at the end of the
    stream they stop short of the last ones. Repeated requests with an id that was told are not told again.
    """
    open_ones = requests.filter(F.coalesce(F.col(request_id), F.lit("")) != "").join(told.select(request_id).distinct(), request_id, "left_anti").alias("q")
    answers = responses.withColumnRenamed(request_id, "_response_id").alias("r")
    in_time = (F.col(f"r.{response_ts}") >= F.col(f"q.{request_ts}")) & (F.col(f"r.{response_ts}") <= F.col(f"q.{request_ts}") + F.expr(f"interval {within}"))
    joined = open_ones.join(answers, (F.col(f"q.{request_id}") == F.col("r._response_id")) & in_time, "left")
    return joined.withColumn("no_response", F.col("_response_id").isNull()).drop("_response_id")


__all__ = ["pair_stream", "pane_buckets", "pane_sums", "running_counters", "running_counts", "seconds", "withheld"]
