"""Streaming queries, run over what is available now and read back as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..plans.routing import route_requests
from ..session import configure
from ..settings import CacheOptions
from ..streaming import metrics as SM
from ..streaming import partials, runs, state
from .common import centroid_head, fixture_config, message, request_body, requested_model, table
from .metering import SQL as METER_SQL
from .metering import SQL_BOUNDS
from .routing import CREATED, SQL_ROUTED
from .vectors import sql_replay

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runs.table_stream(configure(spark), sf_dir, name)


def in_time(spark: SparkSession, sf_dir: str, name: str, *order: str | Column, rows_per_file: int | None = None) -> DataFrame:
    """The whole table as a stream in time order: no row comes behind a watermark, and keyed state sees rows as they happened."""
    return runs.ordered_stream(table(configure(spark), sf_dir, name), *order, rows_per_file=rows_per_file)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, "events")


def _events_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_time(spark, sf_dir, "events", "ts", "event_id")


@query
def streaming_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship plan on a stream of request bodies: same functions, stream-static joins."""
    docs = stream(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    body = request_body(requested_model(F.col("doc_id")), F.array(message(F.lit("user"), F.col("text"))))
    raw = docs.select("doc_id", body.alias("body"), (F.col("doc_id") % vectors.count()).alias("vec_id")).join(vectors, "vec_id")
    routed = route_requests(
        raw, fixture_config(), centroid_head(spark, sf_dir), category_input="embedding", created=F.lit(CREATED)
    )
    out = routed.select("doc_id", "model", "category", "outcome", "served_model", "blocked_model")
    return runs.collect_append(out, "streaming-route")


SQL["streaming_route"] = f"WITH {SQL_ROUTED} SELECT doc_id, model, category, outcome, served_model, blocked_model FROM routed"


@query
def streaming_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running request and token totals per model."""
    ev = _event_stream(spark, sf_dir)
    item = lambda name, n: F.struct(F.lit(name).alias("name"), F.col("event_type").alias("label_1"), F.lit(None).cast("string").alias("label_2"), n.cast("double").alias("amount"))
    items = F.array(item(M.REQUESTS, F.lit(1)), item(M.COMPLETION_TOKENS, F.floor("value")))
    increments = ev.select(F.explode(items).alias("i")).select("i.*")
    done = runs.collect_updates(SM.running_counters(increments), ["name", "label_1", "label_2"], "streaming-counters")
    return done.select("name", "label_1", F.round("value", 6).alias("value"))


SQL["streaming_counters"] = """
SELECT 'llm_model_requests_total' AS name, event_type AS label_1, count(*)::DOUBLE AS value FROM events GROUP BY event_type
UNION ALL SELECT 'llm_model_completion_tokens_total', event_type, sum(floor(value))::DOUBLE FROM events GROUP BY event_type"""


@query
def streaming_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count per category."""
    docs = stream(spark, sf_dir, "documents").select(F.col("source").alias("category"))
    return runs.collect_updates(SM.running_counts(docs, "category"), ["category"], "streaming-categories")


SQL["streaming_category_totals"] = "SELECT source AS category, count(*) AS n FROM documents GROUP BY source"


@query
def streaming_token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rate over sliding five-minute windows from streamed one-minute panes."""
    panes = partials.sum_panes("ts", ["event_type"], F.col("value"), 60)
    done = partials.collect_partials(_event_stream(spark, sf_dir), panes, "streaming-token-rate")
    done = partials.merge_sums(done, ["pane", "event_type"], "value")
    rate = M.pane_rate(done, "pane", ["event_type"], "value", 300, 60)
    return rate.select("window_start", "event_type", F.round("rate", 6).alias("rate"))


SQL["streaming_token_rate"] = METER_SQL["token_rate_5m"]


@query
def streaming_reroute_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reroute rate over sliding windows from streamed panes."""
    ev = _event_stream(spark, sf_dir)
    target = F.when(F.col("user_id") % 2 == 0, F.col("event_type")).otherwise("view")
    changed = ev.withColumn("target", target).filter(F.col("event_type") != F.col("target"))
    done = partials.collect_partials(changed, partials.sum_panes("ts", ["event_type", "target"], F.lit(1), 60), "streaming-reroutes")
    done = partials.merge_sums(done, ["pane", "event_type", "target"], "value")
    rate = M.pane_rate(done, "pane", ["event_type", "target"], "value", 300, 60)
    return rate.select("window_start", "event_type", "target", F.round("rate", 6).alias("rate"))


SQL["streaming_reroute_rate"] = METER_SQL["reroute_rate_5m"]


@query
def streaming_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile per model and day from streamed bucket panes."""
    done = partials.collect_partials(_event_stream(spark, sf_dir), partials.bucket_panes("ts", ["event_type"], F.col("value") / 60, 3600), "streaming-p95")
    day = F.to_date(F.timestamp_seconds("pane")).cast("string")
    per_day = done.groupBy("event_type", day.alias("day"), F.col("bucket").alias("le_idx")).agg(F.sum("n").alias("n"))
    every = F.array(*[F.sum(F.when(F.col("le_idx") <= i, F.col("n")).otherwise(0)) for i in range(len(M.BUCKETS) + 1)])
    hist = per_day.groupBy("event_type", "day").agg(every.alias("c"), F.sum("n").alias("total"))
    long = hist.select("event_type", "day", "total", F.posexplode("c").alias("le_idx", "bucket_count"))
    return M.histogram_quantile(long, ["event_type", "day"], 0.95).select("event_type", "day", F.round("quantile", 6).alias("p95"))


SQL["streaming_p95"] = METER_SQL["latency_p95"]


def _turn_time() -> Column:
    return F.timestamp_seconds(F.lit(CREATED) + F.col("conv_id") * 60 + F.col("turn"))


def _turns_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_time(spark, sf_dir, "conversations", _turn_time(), "conv_id", "turn")


@query
def streaming_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered requests of a stream: a user turn and the assistant turn right after it."""
    turns = _turns_in_time(spark, sf_dir)
    at = _turn_time()
    requests = turns.filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", "turn", at.alias("request_ts")
    )
    responses = turns.filter("role = 'assistant'").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("request_id"), at.alias("response_ts"),
        F.length("text").alias("completion_tokens"),
    )
    paired = SM.pair_stream(requests, responses, "request_id", "request_ts", "response_ts", "1 day", how="inner")
    done = runs.collect_append(paired, "streaming-pairs")
    return done.select("conv_id", "turn", "completion_tokens", "no_response")


SQL["streaming_pairing"] = """SELECT q.conv_id, q.turn, length(r.text)::INT AS completion_tokens, false AS no_response
FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND q.role = 'user' AND r.role = 'assistant'"""


def _with_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set(runs.STATE_CONF, runs.ROCKSDB)
    return spark


VECTORS_PER_FILE = 2_000  # vectors are long rows


def _cache_answers(spark: SparkSession, sf_dir: str, replica: Column, max_entries: int, name: str) -> DataFrame:
    """Every vector asks, and is answered half a second later."""
    vectors = in_time(_with_rocksdb(spark), sf_dir, "embeddings", "vec_id", rows_per_file=VECTORS_PER_FILE)
    base = vectors.select(
        replica.alias("replica"), F.concat(F.lit("model-"), F.col("label") % 3).alias("model"),
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("request_id"), F.col("embedding").cast("array<double>").alias("vector"),
        F.col("vec_id").cast("double").alias("ts"),
    )
    kinds = F.array(F.struct(F.lit("request").alias("kind"), F.lit(0.0).alias("d")), F.struct(F.lit("response").alias("kind"), F.lit(0.5).alias("d")))
    events = base.withColumn("k", F.explode(kinds)).select(
        "replica", "model", "k.kind", "request_id", (F.col("ts") + F.col("k.d")).alias("ts"),
        F.concat(F.lit("prompt "), "request_id").alias("query"), "vector", F.concat(F.lit("answer "), "request_id").alias("body"),
    )
    return runs.collect_append(state.cache_stream(events, CacheOptions(0.3, max_entries, 0)), name)


@query
def streaming_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic cache as keyed state, two replicas."""
    done = _cache_answers(spark, sf_dir, F.concat(F.lit("replica-"), F.col("label") % 2), 1000, "streaming-cache")
    return done.select("replica", "model", "request_id", "hit", "match_id", F.round("score", 6).alias("score"))


SQL["streaming_cache"] = f"""WITH RECURSIVE {sql_replay("(({t}.label % 2) * 10 + {t}.label % 3)")}
SELECT 'replica-' || (v.label % 2) AS replica, 'model-' || (v.label % 3) AS model, lpad(v.vec_id::VARCHAR, 12, '0') AS request_id,
  h.m IS NOT NULL AS hit, lpad(h.m::VARCHAR, 12, '0') AS match_id, round(h.s, 6) AS score
FROM embeddings v LEFT JOIN hits h ON h.q = v.vec_id"""


@query
def streaming_cache_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that starts with every fourth vector as a complete entry; the others ask, and no answer comes meanwhile."""
    rows = table(_with_rocksdb(spark), sf_dir, "embeddings")
    shape = lambda df: df.select(
        F.lit("replica-0").alias("replica"), F.concat(F.lit("model-"), F.col("label")).alias("model"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("request_id"),
        F.col("vec_id").cast("double").alias("ts"), F.concat(F.lit("prompt "), F.col("vec_id")).alias("query"), F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("answer "), F.col("vec_id")).alias("body"),
    )
    asking = shape(stream(spark, sf_dir, "embeddings").filter("vec_id % 4 != 0")).withColumn("kind", F.lit("request"))
    preload = shape(rows.filter("vec_id % 4 = 0"))
    done = runs.collect_append(state.cache_stream(asking, CacheOptions(0.2, 0, 0), preload), "streaming-preload")
    return done.select("model", "request_id", "hit", "match_id", F.round("score", 6).alias("score"), "body")


SQL["streaming_cache_preload"] = """
WITH p AS (SELECT q.vec_id AS q, e.vec_id AS e, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id % 4 <> 0 AND e.vec_id % 4 = 0),
h AS (SELECT q, max_by(e, (s, e)) AS m, max(s) AS s FROM p WHERE s >= 0.2 GROUP BY q)
SELECT 'model-' || label AS model, lpad(vec_id::VARCHAR, 12, '0') AS request_id, m IS NOT NULL AS hit, lpad(m::VARCHAR, 12, '0') AS match_id, round(s, 6) AS score, 'answer ' || m AS body
FROM embeddings LEFT JOIN h ON q = vec_id WHERE vec_id % 4 <> 0"""


@query
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replica's log through the keyed cache: what is inserted, what hits which entry."""
    done = _cache_answers(spark, sf_dir, F.lit("replica-0"), 0, "cache-replay")
    return done.select(
        F.col("request_id").cast("bigint").alias("vec_id"), "model", (~F.col("hit")).alias("inserted"), "hit",
        F.col("match_id").cast("bigint").alias("match_id"), F.round("score", 6).alias("score"),
    )


SQL["cache_replay"] = f"""WITH RECURSIVE {sql_replay("({t}.label % 3)")}
SELECT v.vec_id, 'model-' || (v.label % 3) AS model, l.id IS NOT NULL AS inserted, l.id IS NULL AS hit, h.m AS match_id, round(h.s, 6) AS score
FROM embeddings v LEFT JOIN last l ON l.id = v.vec_id LEFT JOIN hits h ON h.q = v.vec_id"""


@query
def streaming_p95_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile per model over sliding five-minute windows, one window per minute, from streamed bucket panes."""
    done = partials.collect_partials(_event_stream(spark, sf_dir), partials.bucket_panes("ts", ["event_type"], F.col("value") / 60, 60), "streaming-p95-5m")
    done = partials.merge_sums(done, ["pane", "event_type", "bucket"], "n")
    rates = M.pane_rate(done, "pane", ["event_type", "bucket"], "n", 300, 60)
    counts = rates.select("window_start", "event_type", F.col("bucket").alias("le_idx"), F.round(F.col("rate") * 300).cast("bigint").alias("n"))
    every = F.array(*[F.sum(F.when(F.col("le_idx") <= i, F.col("n")).otherwise(0)) for i in range(len(M.BUCKETS) + 1)])
    hist = counts.groupBy("window_start", "event_type").agg(every.alias("c"), F.sum("n").alias("total"))
    long = hist.select("window_start", "event_type", "total", F.posexplode("c").alias("le_idx", "bucket_count"))
    return M.histogram_quantile(long, ["window_start", "event_type"], 0.95).select("window_start", "event_type", F.round("quantile", 6).alias("p95"))


SQL["streaming_p95_5m"] = f"""WITH b(i, le, x) AS (VALUES {SQL_BOUNDS}),
e AS (SELECT event_type, value, (floor(epoch(ts) / 60) * 60)::BIGINT - o * 60 AS window_start FROM events, range(0, 5) r(o)),
h AS (SELECT event_type, window_start, i, x, count(*) FILTER (value / 60 <= x) AS c, count(*) AS t FROM e, b GROUP BY ALL),
w AS (SELECT *, coalesce(lag(c) OVER o, 0) AS pc, coalesce(lag(x) OVER o, 0.0) AS px FROM h WINDOW o AS (PARTITION BY event_type, window_start ORDER BY i)),
f AS (SELECT *, row_number() OVER (PARTITION BY event_type, window_start ORDER BY i) AS rn FROM w WHERE c >= 0.95::DOUBLE * t)
SELECT window_start, event_type, round(CASE WHEN i = {len(M.BUCKETS)} THEN {M.BUCKETS[-1]} ELSE px + (x - px) * (0.95::DOUBLE * t - pc) / (c - pc) END, 6) AS p95 FROM f WHERE rn = 1"""


@query
def streaming_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile per model and day from hourly sketches, finer than the latency buckets, and whether their ranks are right.

    A quantile's rank among the day's values may be off by 3 %.
    """
    done = partials.collect_partials(_event_stream(spark, sf_dir), partials.sketch_panes("ts", ["event_type"], F.col("value"), 3600), "streaming-quantiles")
    daily = partials.merge_sketches(done, ["event_type", F.to_date(F.timestamp_seconds("pane")).cast("string").alias("day")])
    shares = {"p50": 0.5, "p95": 0.95}
    asked = daily.select("event_type", "day", "n", *[partials.quantile("sketch", q).alias(name) for name, q in shares.items()])
    values = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("day"), "value")
    upto = values.join(asked, ["event_type", "day"]).groupBy("event_type", "day", "n").agg(
        *[F.avg((F.col("value") <= F.col(p)).cast("double")).alias(f"{p}_upto") for p in shares],
        *[F.avg((F.col("value") < F.col(p)).cast("double")).alias(f"{p}_below") for p in shares],
    )
    near = [((F.col(f"{p}_below") - 0.03 <= q) & (F.col(f"{p}_upto") + 0.03 >= q)).alias(f"{p}_near") for p, q in shares.items()]
    return upto.select("event_type", "day", "n", *near)


SQL["streaming_quantiles"] = """
SELECT event_type, ts::DATE::VARCHAR AS day, count(value) AS n, true AS p50_near, true AS p95_near FROM events WHERE value IS NOT NULL GROUP BY ALL"""


@query
def streaming_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per model of a stream that keeps what comes more than an hour behind the watermark apart: none is lost."""
    in_time_rows, late = partials.collect_split(
        _event_stream(spark, sf_dir), "ts", 3600, partials.sum_panes("ts", ["event_type"], F.lit(1), 60), "streaming-late"
    )
    both = in_time_rows.select("event_type", F.col("value").alias("n")).unionByName(late.select("event_type", F.lit(1).cast("bigint").alias("n")))
    return both.groupBy("event_type").agg(F.sum("n").alias("n"))


SQL["streaming_late_rows"] = "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"


@query
def streaming_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user turns with their answer, if there is one: told once both watermarks are past their wait, the last ones when the stream ends."""
    turns, at = _turns_in_time(spark, sf_dir), _turn_time()
    asked = lambda t: t.filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), "conv_id", "turn", at.alias("request_ts"))
    answered = lambda t: t.filter("role = 'assistant' AND conv_id % 4 != 0").select(
        F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("request_id"), at.alias("response_ts")
    )
    paired = SM.pair_stream(asked(turns), answered(turns), "request_id", "request_ts", "response_ts", "1 minute", "1 minute")
    told = runs.collect_append(paired, "streaming-unanswered")
    rest = SM.withheld(asked(table(spark, sf_dir, "conversations")), answered(table(spark, sf_dir, "conversations")), told, "request_id", "request_ts", "response_ts", "1 minute")
    return told.select("conv_id", "turn", "no_response").unionByName(rest.select("conv_id", "turn", "no_response"))


SQL["streaming_unanswered"] = """
WITH q AS (SELECT * FROM conversations WHERE role = 'user'), r AS (SELECT * FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 0)
SELECT q.conv_id, q.turn, r.conv_id IS NULL AS no_response FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1"""


@query
def streaming_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-flight load of batches that follow each other, each scanned in parts."""
    ev = _events_in_time(spark, sf_dir)
    events = ev.select(
        F.concat(F.lit("replica-"), F.col("user_id") % 2).alias("replica"), F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"),
        "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1).alias("step"),
    )
    return state.collect_load(events, "streaming-load")


SQL["streaming_load"] = """
WITH d AS (SELECT event_id, ts, 'replica-' || (user_id % 2) AS replica, 'model-' || (user_id % 3) AS model,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS d FROM events),
s AS (SELECT *, sum(d) OVER (PARTITION BY replica, model ORDER BY ts, event_id) AS s FROM d)
SELECT replica, model, event_id, (s - least(0, min(s) OVER (PARTITION BY replica, model ORDER BY ts, event_id)))::INT AS load FROM s"""
