"""Counters, histograms, rates, pairing and in-flight load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache, metrics
from ..operators.selection import inflight_load as load_scan
from ..operators.metrics import BUCKETS
from ..plans.metering import gateway_counters, serve
from .common import SQL_MODEL, requested_model, sql_values, table
from .routing import SQL_ROUTED, route_documents

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log read as a response log: type = model, value = tokens or latency."""
    return table(spark, sf_dir, "events")


@query
def requests_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(requested_model(F.col("doc_id")).alias("model"))
    return metrics.count_by(rows, "model")


SQL["requests_by_model"] = f"SELECT {SQL_MODEL.format(id='doc_id')} AS model, count(*) AS n FROM documents GROUP BY 1"


@query
def tokens_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(
        "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("p"), F.floor("value").cast("bigint").alias("c")
    )
    return metrics.tokens_by_model(rows, "event_type", F.col("p"), F.col("c"))


SQL["tokens_by_model"] = """SELECT event_type, sum((props->>'$.k')::BIGINT + floor(value)::BIGINT)::BIGINT AS total_tokens,
  sum((props->>'$.k')::BIGINT)::BIGINT AS prompt_tokens, sum(floor(value)::BIGINT)::BIGINT AS completion_tokens FROM events GROUP BY event_type"""


@query
def reroutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_documents(spark, sf_dir).filter("outcome = 'routed'")
    return metrics.reroutes(routed, "model", "served_model")


SQL["reroutes"] = f"""WITH {SQL_ROUTED} SELECT model, served_model, count(*) AS n FROM routed
WHERE outcome = 'routed' AND model <> served_model GROUP BY ALL"""


@query
def pii_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = route_documents(spark, sf_dir).filter("outcome = 'pii_blocked'")
    return metrics.violations(blocked.withColumn("types", F.split("denied", " ")), "blocked_model", "types")


SQL["pii_violations"] = f"""WITH {SQL_ROUTED} SELECT blocked_model, denied AS pii_type, count(*) AS n FROM routed
WHERE outcome = 'pii_blocked' GROUP BY ALL"""


@query
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each category was classified; the fallback path classifies twice."""
    rows = route_documents(spark, sf_dir).filter("times_classified > 0")
    return rows.groupBy("category").agg(F.sum("times_classified").alias("n"))


SQL["category_totals"] = f"""WITH {SQL_ROUTED} SELECT category, sum(times_classified)::BIGINT AS n FROM routed
WHERE times_classified > 0 GROUP BY category"""


@query
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative latency buckets per model."""
    hist = metrics.histogram(events(spark, sf_dir), ["event_type"], F.col("value") / 20)
    return hist.select("event_type", F.col("le").cast("string").alias("le"), "bucket_count", "total", F.round("value_sum", 6).alias("value_sum"))


SQL_BOUNDS = sql_values((i, str(b), b) for i, b in enumerate([*BUCKETS, 1e308]))
SQL_BOUNDS = SQL_BOUNDS.replace("'1e+308'", "'Infinity'")
SQL["latency_histogram"] = f"""WITH b(i, le, x) AS (VALUES {SQL_BOUNDS}),
s AS (SELECT event_type, count(*) AS total, round(sum(value / 20), 6) AS value_sum FROM events GROUP BY event_type)
SELECT e.event_type, b.le, count(*) FILTER (value / 20 <= b.x) AS bucket_count, s.total, s.value_sum
FROM events e JOIN s USING (event_type), b GROUP BY ALL"""


@query
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile of latency per model and day from the buckets."""
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    hist = metrics.histogram(rows, ["event_type", "day"], F.col("value") / 60)
    return metrics.histogram_quantile(hist, ["event_type", "day"], 0.95).select("event_type", "day", F.round("quantile", 6).alias("p95"))


SQL["latency_p95"] = f"""WITH b(i, le, x) AS (VALUES {SQL_BOUNDS}),
h AS (SELECT event_type, ts::DATE::VARCHAR AS day, i, x, count(*) FILTER (value / 60 <= x) AS c, count(*) AS t FROM events, b GROUP BY ALL),
w AS (SELECT *, coalesce(lag(c) OVER o, 0) AS pc, coalesce(lag(x) OVER o, 0.0) AS px FROM h WINDOW o AS (PARTITION BY event_type, day ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY i) AS rn FROM w WHERE c >= 0.95::DOUBLE * t)
SELECT event_type, day, round(CASE WHEN i = {len(BUCKETS)} THEN {BUCKETS[-1]} ELSE px + (x - px) * (0.95::DOUBLE * t - pc) / (c - pc) END, 6) AS p95 FROM f WHERE rn = 1"""


@query
def routing_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled histogram over the requests whose routing was finished."""
    rows = route_documents(spark, sf_dir).filter(F.col("outcome").isin("routed", "passed"))
    hist = metrics.histogram(rows, [], (F.col("doc_id") % 3000) / 1000)
    return hist.select(F.col("le").cast("string").alias("le"), "bucket_count", "total")


SQL["routing_latency_histogram"] = f"""WITH {SQL_ROUTED}, b(i, le, x) AS (VALUES {SQL_BOUNDS})
SELECT b.le, count(*) FILTER ((doc_id % 3000) / 1000 <= b.x) AS bucket_count, count(*) AS total FROM routed, b
WHERE outcome IN ('routed', 'passed') GROUP BY b.le"""


@query
def token_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rate per model over sliding five-minute windows, one window per minute."""
    rate = metrics.sliding_rate(events(spark, sf_dir), "ts", ["event_type"], F.col("value"), 300, 60)
    return rate.select("window_start", "event_type", F.round("rate", 6).alias("rate"))


SQL["token_rate_5m"] = """
WITH p AS (SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS pane, event_type, sum(value) AS v FROM events GROUP BY ALL)
SELECT pane - o * 60 AS window_start, event_type, round(sum(v) / 300, 6) AS rate FROM p, range(0, 5) r(o) GROUP BY ALL"""


@query
def reroute_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reroutes per second by source and target over sliding windows, from a model-change log."""
    rows = events(spark, sf_dir).withColumn("target", F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("view"))
    changed = rows.filter(F.col("event_type") != F.col("target"))
    rate = metrics.sliding_rate(changed, "ts", ["event_type", "target"], F.lit(1), 300, 60)
    return rate.select("window_start", "event_type", "target", F.round("rate", 6).alias("rate"))


SQL["reroute_rate_5m"] = """
WITH c AS (SELECT ts, event_type, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'view' END AS target FROM events),
p AS (SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS pane, event_type, target, count(*) AS v FROM c WHERE event_type <> target GROUP BY ALL)
SELECT pane - o * 60 AS window_start, event_type, target, round(sum(v) / 300, 6) AS rate FROM p, range(0, 5) r(o) GROUP BY ALL"""


@query
def inflight_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open requests per model after every event, never below zero."""
    rows = events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"), "event_type")
    delta = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1)
    scanned = load_scan(rows, "model", ["ts", "event_id"], delta, F.date_trunc("day", "ts"), F.date_trunc("minute", "ts"))
    return scanned.select("event_id", "model", "load")


SQL["inflight_load"] = """
WITH d AS (SELECT event_id, ts, 'model-' || (user_id % 3) AS model, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS d FROM events),
s AS (SELECT *, sum(d) OVER (PARTITION BY model ORDER BY ts, event_id) AS s FROM d)
SELECT event_id, model, (s - least(0, min(s) OVER (PARTITION BY model ORDER BY ts, event_id)))::INT AS load FROM s"""


@query
def cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pending entry each response completes, when equal queries wait in line."""
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type", F.concat(F.lit("query "), F.col("user_id")).alias("query"))
    answers = F.col("event_type").isin("purchase", "error", "signup")
    pending = rows.filter(~answers).select("query", F.col("event_id").alias("pending_id"), "ts")
    responses = rows.filter(answers).select("query", F.col("event_id").alias("response_id"), F.col("ts").alias("response_ts"))
    filled = cache.fill(pending, responses, "query", "pending_id", "response_id", "ts", "response_ts", 86_400)
    return filled.select("pending_id", "response_id")


SQL["cache_fill"] = """
WITH e AS (SELECT event_id, ts, user_id, event_type IN ('purchase', 'error', 'signup') AS r FROM events),
a AS (SELECT *, sum(CASE WHEN r THEN -1 ELSE 1 END) OVER w AS s, sum(CASE WHEN r THEN 1 ELSE 0 END) OVER w AS nr,
        sum(CASE WHEN r THEN 0 ELSE 1 END) OVER w AS np FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, r, event_id)),
b AS (SELECT *, greatest(0, -min(s) OVER w) AS lost FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, r, event_id)),
c AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY user_id ORDER BY ts, r, event_id), 0) AS before FROM b)
SELECT p.event_id AS pending_id, q.event_id AS response_id FROM c p JOIN c q
  ON p.user_id = q.user_id AND NOT p.r AND q.r AND q.lost = q.before AND p.np = q.nr - q.lost"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are requests, the assistant turns right after them their responses.

    Every eleventh request has no id and never pairs.
    """
    turns = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    requests = turns.filter("role = 'user'").select(
        F.when((F.col("conv_id") + F.col("turn")) % 11 != 0, key).alias("request_id"), "conv_id", "turn",
        F.element_at(F.array(F.lit("phi4"), F.lit("gemma3:27b"), F.lit("mistral-small3.1")), (F.col("conv_id") % 3 + 1).cast("int")).alias("served_model"),
        (F.col("conv_id") * 1000 + F.col("turn") * 10).alias("request_ts"),
    )
    usage = F.struct(F.struct(F.lit(3).alias("prompt_tokens"), F.length("text").alias("completion_tokens")).alias("usage"))
    body = F.when(F.col("turn") % 5 == 3, F.col("text")).otherwise(F.to_json(usage))
    responses = turns.filter("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("request_id"),
        (F.col("conv_id") * 1000 + F.col("turn") * 10 + F.length("text") % 20 - 9).alias("response_ts"), body.alias("response_body"),
    )
    return serve(requests, responses, "request_id", "request_ts", "response_ts", "response_body")


SQL_PAIRED = """
req AS (SELECT conv_id, turn, (conv_id + turn) % 11 <> 0 AS has_id, ['phi4', 'gemma3:27b', 'mistral-small3.1'][(conv_id % 3 + 1)::INT] AS served_model
  FROM conversations WHERE role = 'user'),
paired AS (SELECT r.*, c.turn IS NOT NULL AS answered,
    CASE WHEN c.turn % 5 <> 3 THEN 3 ELSE 0 END AS p, CASE WHEN c.turn % 5 <> 3 THEN length(c.text) ELSE 0 END AS c,
    (1 + length(c.text) % 20) AS latency
  FROM req r LEFT JOIN conversations c ON c.role = 'assistant' AND r.has_id AND c.conv_id = r.conv_id AND c.turn = r.turn + 1)"""


@query
def request_response_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and latency of every request; unanswered ones keep their row."""
    return _paired(spark, sf_dir).select("conv_id", "turn", "served_model", "answered", "prompt_tokens", "completion_tokens", "latency")


SQL["request_response_pairs"] = f"""WITH {SQL_PAIRED}
SELECT conv_id, turn, served_model, answered, p::BIGINT AS prompt_tokens, c::BIGINT AS completion_tokens,
  latency::DOUBLE AS latency FROM paired"""


@query
def gateway_counter_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every counter of routed documents and answered conversation turns in one pass each."""
    decided = route_documents(spark, sf_dir).withColumn("denied", F.filter(F.split("denied", " "), lambda t: t != ""))
    totals = gateway_counters(decided, _paired(spark, sf_dir), (F.col("doc_id") % 3000) / 1000)
    return totals.select("name", "label_1", "label_2", F.round("value", 6).alias("value"))


SQL_INDEX = "CASE " + " ".join(f"WHEN {{x}} <= {b} THEN '{i}'" for i, b in enumerate(BUCKETS)) + f" ELSE '{len(BUCKETS)}' END"
SQL["gateway_counter_snapshot"] = f"""WITH {SQL_ROUTED}, {SQL_PAIRED}, series(name, label_1, label_2, v) AS (
SELECT 'llm_model_requests_total', model, NULL, 1.0 FROM routed
UNION ALL SELECT 'llm_model_routing_modifications_total', model, served_model, 1 FROM routed WHERE outcome = 'routed'
UNION ALL SELECT 'llm_category_classifications_total', category, NULL, times_classified FROM routed WHERE times_classified > 0
UNION ALL SELECT 'llm_pii_violations_total', blocked_model, denied, 1 FROM routed WHERE outcome = 'pii_blocked'
UNION ALL SELECT 'llm_model_routing_latency_seconds_bucket', {SQL_INDEX.format(x='(doc_id % 3000) / 1000')}, NULL, 1 FROM routed WHERE outcome IN ('routed', 'passed')
UNION ALL SELECT 'llm_model_routing_latency_seconds_sum', NULL, NULL, (doc_id % 3000) / 1000 FROM routed WHERE outcome IN ('routed', 'passed')
UNION ALL SELECT 'llm_model_tokens_total', served_model, NULL, p + c FROM paired WHERE answered
UNION ALL SELECT 'llm_model_prompt_tokens_total', served_model, NULL, p FROM paired WHERE answered
UNION ALL SELECT 'llm_model_completion_tokens_total', served_model, NULL, c FROM paired WHERE answered
UNION ALL SELECT 'llm_model_completion_latency_seconds_bucket', served_model, {SQL_INDEX.format(x='latency')}, 1 FROM paired WHERE answered
UNION ALL SELECT 'llm_model_completion_latency_seconds_sum', served_model, NULL, latency FROM paired WHERE answered)
SELECT name, label_1, label_2, round(sum(v::DOUBLE), 6) AS value FROM series GROUP BY ALL"""
