"""Gateway metrics from routed requests and their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import parse_usage
from ..operators import metrics


def serve(decided: DataFrame, responses: DataFrame, request_id: str, request_ts: str, response_ts: str, body: str) -> DataFrame:
    """Pair requests with responses and read tokens and latency.

    Tokens and latency belong to the model that served the request. An unreadable
    response counts with zero tokens; a missing one gives ``answered = false``.
    """
    paired = metrics.pair_responses(decided, responses, request_id)
    usage = paired.withColumn("_usage", parse_usage(F.col(body)))
    return (
        usage.withColumn("answered", F.col(response_ts).isNotNull())
        .withColumn("prompt_tokens", F.col("_usage.prompt_tokens"))
        .withColumn("completion_tokens", F.col("_usage.completion_tokens"))
        .withColumn("latency", (F.col(response_ts) - F.col(request_ts)).cast("double"))
        .drop("_usage")
    )


def gateway_counters(decided: DataFrame, served: DataFrame, routing_latency: Column | None = None) -> DataFrame:
    """All counters in the compact form ``(name, label_1, label_2, value)``."""
    requests = metrics.request_increments(decided, routing_latency)
    answers = metrics.response_increments(
        served.filter("answered"), "served_model", F.col("prompt_tokens"), F.col("completion_tokens"), F.col("latency")
    )
    return metrics.counters(requests.unionByName(answers))


def gateway_metrics(decided: DataFrame, served: DataFrame, routing_latency: Column | None = None) -> DataFrame:
    """Readable snapshot ``(name, labels, value)`` of every series."""
    return metrics.snapshot(gateway_counters(decided, served, routing_latency))
