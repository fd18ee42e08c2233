"""Counters, histograms, quantiles and rates over request and response tables.

All counters of one table are computed in a single pass: each row lists the series
it increments, and one partial aggregate per task collapses them before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds

# --- Fixed values: series names and histogram bounds (seconds) ----------------
REQUESTS = "llm_model_requests_total"
TOKENS = "llm_model_tokens_total"
PROMPT_TOKENS = "llm_model_prompt_tokens_total"
COMPLETION_TOKENS = "llm_model_completion_tokens_total"
REROUTES = "llm_model_routing_modifications_total"
COMPLETION_LATENCY = "llm_model_completion_latency_seconds"
ROUTING_LATENCY = "llm_model_routing_latency_seconds"
CACHE_HITS = "llm_cache_hits_total"
CATEGORIES = "llm_category_classifications_total"
PII_VIOLATIONS = "llm_pii_violations_total"
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# ------------------------------------------------------------------------------


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def tokens_by_model(responses: DataFrame, model: str, prompt: Column, completion: Column) -> DataFrame:
    """Token sums per serving model; the total is prompt plus completion."""
    named = responses.filter(F.coalesce(F.col(model), F.lit("")) != "")
    return named.groupBy(model).agg(
        F.sum(prompt + completion).alias("total_tokens"),
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
    )


def reroutes(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.filter(F.col(source) != F.col(target)).groupBy(source, target).agg(F.count("*").alias("n"))


def violations(blocked: DataFrame, model: str, denied: str) -> DataFrame:
    """Blocked requests per model and denied type."""
    return blocked.select(model, F.explode(denied).alias("pii_type")).groupBy(model, "pii_type").agg(F.count("*").alias("n"))


def bucket_index(value: Column, bounds: list[float] | None = None) -> Column:
    """Index of the first bound at or above the value; ``len(bounds)`` beyond all."""
    bounds = bounds or BUCKETS
    expr = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        expr = F.when(value <= bounds[i], i).otherwise(expr)
    return expr


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative buckets per key: ``(keys, le_idx, le, bucket_count, total, value_sum)``.

    Rows are counted per bucket they fall in, so a row is never copied per bound;
    the cumulative form is made from the few counts.
    """
    bounds = bounds or BUCKETS
    observed = df.filter(value.isNotNull()).select(*keys, value.alias("_x"), bucket_index(value, bounds).alias("_i"))
    per_bucket = observed.groupBy(*keys, "_i").agg(F.count("*").alias("_n"), F.sum("_x").alias("_s"))
    counts = F.array(*[F.sum(F.when(F.col("_i") == i, F.col("_n")).otherwise(0)) for i in range(len(bounds) + 1)])
    per_key = per_bucket.groupBy(*keys).agg(counts.alias("_counts"), F.sum("_n").alias("total"), F.sum("_s").alias("value_sum"))
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    rows = per_key.select(*keys, "total", "value_sum", "_counts", F.posexplode(les).alias("le_idx", "le"))
    upto = F.aggregate(F.slice("_counts", 1, F.col("le_idx") + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(*keys, "le_idx", "le", upto.alias("bucket_count"), "total", "value_sum")


def histogram_quantile(hist: DataFrame, keys: list[str], q: float, bounds: list[float] | None = None) -> DataFrame:
    """Quantile per key by interpolation inside the bucket; the open bucket gives the highest bound."""
    bounds = bounds or BUCKETS
    counts = F.transform(F.array_sort(F.collect_list(F.struct("le_idx", "bucket_count"))), lambda s: s["bucket_count"])
    per_key = hist.groupBy(*keys).agg(counts.alias("_c"), F.max("total").alias("_t"))
    rank = F.col("_t") * F.lit(q)
    edges = F.array(F.lit(0.0), *[F.lit(float(b)) for b in bounds])
    index = F.size(F.filter("_c", lambda c: c < rank))
    placed = per_key.withColumn("_r", rank).withColumn("_i", index)
    below = F.when(F.col("_i") > 0, F.get("_c", F.col("_i") - 1)).otherwise(0)
    low, high = F.get(edges, F.col("_i")), F.get(edges, F.col("_i") + 1)
    inside = low + (high - low) * F.try_divide(F.col("_r") - below, F.get("_c", F.col("_i")) - below)
    value = F.when(F.col("_i") >= len(bounds), F.lit(float(bounds[-1]))).otherwise(inside)
    return placed.filter("_t > 0").select(*keys, value.alias("quantile"))


def sliding_rate(df: DataFrame, ts: str, keys: list[str], value: Column, window: int, slide: int) -> DataFrame:
    """Per-second rate over sliding windows: ``(window_start, keys, rate)``.

    Rows are first summed into panes of one slide; only panes are copied into the
    windows that contain them.
    """
    if window % slide:
        raise ValueError("window must be a multiple of slide")
    pane = (F.floor(seconds(df, ts) / slide) * slide).alias("_pane")
    panes = df.groupBy(pane, *keys).agg(F.sum(value).alias("_v"))
    return pane_rate(panes, "_pane", keys, "_v", window, slide)


def pane_rate(panes: DataFrame, pane: str, keys: list[str], value: str, window: int, slide: int) -> DataFrame:
    starts = F.sequence(F.col(pane) - (window - slide), F.col(pane), F.lit(slide).cast("bigint"))
    spread = panes.select(F.explode(starts).alias("window_start"), *keys, value)
    return spread.groupBy("window_start", *keys).agg((F.sum(value) / window).alias("rate"))


def request_increments(decided: DataFrame, latency: Column | None = None) -> DataFrame:
    """Series increments of routed requests: ``(name, label_1, label_2, amount)``.

    Needs ``model, outcome, served_model, blocked_model, denied, category,
    times_classified``. Every parsed request counts under its requested model, also
    when it is blocked later; routing latency counts only where routing was finished.
    """
    item = lambda name, a, b, n: F.struct(
        F.lit(name).alias("name"), a.cast("string").alias("label_1"), b.cast("string").alias("label_2"), n.cast("double").alias("amount")
    )
    null, one = F.lit(None), F.lit(1)
    outcome = F.col("outcome")
    done = outcome.isin("routed", "passed")
    items = [
        F.when(outcome != "invalid", item(REQUESTS, F.col("model"), null, one)),
        F.when((outcome == "routed") & (F.col("model") != F.col("served_model")), item(REROUTES, F.col("model"), F.col("served_model"), one)),
        F.when(F.col("times_classified") > 0, item(CATEGORIES, F.col("category"), null, F.col("times_classified"))),
        F.when(outcome == "cache_hit", item(CACHE_HITS, null, null, one)),
    ]
    if latency is not None:
        items.append(F.when(done, item(ROUTING_LATENCY + "_bucket", bucket_index(latency), null, one)))
        items.append(F.when(done, item(ROUTING_LATENCY + "_sum", null, null, latency)))
    blocked = F.transform("denied", lambda t: item(PII_VIOLATIONS, F.col("blocked_model"), t, one))
    return decided.select(F.explode(F.concat(F.array_compact(F.array(*items)), blocked)).alias("_i")).select("_i.*")


def response_increments(paired: DataFrame, model: str, prompt: Column, completion: Column, latency: Column) -> DataFrame:
    """Series increments of responses; rows without a serving model are skipped."""
    item = lambda name, b, n: F.struct(
        F.lit(name).alias("name"), F.col(model).alias("label_1"), b.cast("string").alias("label_2"), n.cast("double").alias("amount")
    )
    null = F.lit(None)
    items = F.array(
        item(TOKENS, null, prompt + completion), item(PROMPT_TOKENS, null, prompt), item(COMPLETION_TOKENS, null, completion),
        item(COMPLETION_LATENCY + "_bucket", bucket_index(latency), F.lit(1)), item(COMPLETION_LATENCY + "_sum", null, latency),
    )
    named = paired.filter(F.coalesce(F.col(model), F.lit("")) != "")
    return named.select(F.explode(items).alias("_i")).select("_i.*")


def counters(increments: DataFrame) -> DataFrame:
    """Sum increments into the snapshot ``(name, label_1, label_2, value)``."""
    return increments.groupBy("name", "label_1", "label_2").agg(F.sum("amount").alias("value"))


def snapshot(totals: DataFrame) -> DataFrame:
    """The readable form ``(name, labels MAP, value)``; bucket series become cumulative.

    Plain and bucket series go through the same aggregate, so the totals behind them
    are computed once. Completion buckets carry (model, index), routing buckets the
    index alone.
    """
    is_bucket = F.col("name").endswith("_bucket")
    rows = totals.select(
        "name", "value", is_bucket.alias("is_bucket"),
        F.when(is_bucket & F.col("label_2").isNull(), None).otherwise(F.col("label_1")).alias("a"),
        F.when(~is_bucket, F.col("label_2")).alias("b"),
        F.when(is_bucket, F.coalesce("label_2", "label_1").cast("int")).alias("i"),
    )
    counts = F.array(*[F.sum(F.when(F.col("i") == k, F.col("value")).otherwise(0.0)) for k in range(len(BUCKETS) + 1)])
    keyed = rows.groupBy("name", "is_bucket", "a", "b").agg(F.sum("value").alias("value"), counts.alias("c"))
    names = {REROUTES: ("source_model", "target_model"), PII_VIOLATIONS: ("model", "pii_type"), CATEGORIES: ("category", "-")}
    pick = lambda part, other: F.coalesce(*[F.when(F.col("name") == n, F.lit(p[part])) for n, p in names.items()], F.lit(other))
    given = lambda *pairs: F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    les = F.array(*[F.lit(str(b)) for b in BUCKETS], F.lit("+Inf"))
    upto = lambda k: F.aggregate(F.slice("c", 1, k + 1), F.lit(0.0), lambda acc, x: acc + x)
    buckets = F.transform(les, lambda le, k: F.struct(given(F.lit("model"), F.col("a"), F.lit("le"), le).alias("labels"), upto(k).alias("value")))
    single = F.array(F.struct(given(pick(0, "model"), F.col("a"), pick(1, "-"), F.col("b")).alias("labels"), F.col("value").alias("value")))
    return keyed.select("name", F.explode(F.when(F.col("is_bucket"), buckets).otherwise(single)).alias("s")).select("name", "s.labels", "s.value")


def pair_responses(requests: DataFrame, responses: DataFrame, request_id: str) -> DataFrame:
    """Left join of requests to responses on the request id.

    Requests without an id never pair. They get a row number as second join key, so
    that they do not all meet on one key.
    """
    has_id = F.coalesce(F.col(request_id), F.lit("")) != ""
    left = requests.withColumn("_k", F.coalesce(F.col(request_id), F.lit(""))).withColumn(
        "_n", F.when(has_id, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    )
    right = (
        responses.filter(has_id).withColumnRenamed(request_id, "_k").withColumn("_n", F.lit(0).cast("bigint"))
    )
    return left.join(right, ["_k", "_n"], "left").drop("_k", "_n")
