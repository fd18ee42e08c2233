"""End-to-end routing of chat requests as one projection over broadcast dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat
from ..operators import cache
from ..operators.policy import denied_types, policies, policy_literal
from ..operators.scorers import GuardRules, PiiRules, Scorer
from ..operators.screening import category_decision, screen_requests
from ..operators.selection import best_allowed, best_candidate, candidate_table, load_aware_scores, ttft_table
from ..session import cut_lineage
from ..settings import AUTO_MODEL, CATEGORY_LABELS, CacheOptions, RouterConfig, models_table, scores_table

OUTCOMES = ("invalid", "jailbreak_blocked", "cache_hit", "routed", "passed", "pii_blocked")


def parse_requests(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add ``ok``, ``model``, ``messages`` and the content columns used further on."""
    # A generator of one row: nothing above it is computed below it, so a filter on the outcome
    # does not repeat the parse.
    parsed = raw.select(*raw.columns, F.inline(F.array(chat.parse_request(F.col(body)))))
    split = parsed.withColumn("messages", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")))
    return with_contents(split)


def with_contents(requests: DataFrame) -> DataFrame:
    user, others = chat.user_content(F.col("messages")), chat.non_user_contents(F.col("messages"))
    return (
        requests.withColumn("user_content", user)
        .withColumn("non_user", others)
        .withColumn("contents", chat.content_list(F.col("user_content"), F.col("non_user")))
        .withColumn("text", chat.classification_text(F.col("user_content"), F.col("non_user")))
    )


def decide(
    requests: DataFrame,
    config: RouterConfig,
    scores: DataFrame | None = None,
    models: DataFrame | None = None,
    load: DataFrame | None = None,
) -> DataFrame:
    """Add the routing decision to screened and classified requests.

    Needs ``ok, model, text, category, detected, jailbreak``; uses ``cached_body``
    (NULL for a miss) if present. Adds ``matched_model``, ``outcome``,
    ``served_model``, ``denied`` and ``times_classified``.

    Security comes before the cache and the cache before routing: the flags have
    no side effects, so one CASE keeps that order.
    """
    spark = requests.sparkSession
    scores = scores_table(spark, config) if scores is None else scores
    models = models_table(spark, config) if models is None else models
    if config.load_aware:
        load = spark.createDataFrame([], "model string, load int") if load is None else load
        scores = load_aware_scores(scores, ttft_table(spark, config, scores), load)
    cands = candidate_table(scores, models)
    own = policies(models).withColumnRenamed("policy", "_own_policy")
    matched_policy = policies(models).select(F.col("model").alias("matched_model"), F.col("policy").alias("_policy"))
    default = config.default_model

    category, detected = F.col("category"), F.col("detected")
    auto = (F.col("model") == AUTO_MODEL) & (F.col("text") != "")
    has_categories = bool(config.categories)
    # Without any category list every text goes to the default model.
    matched = F.when(category != "", best_candidate(F.col("candidates"), default)).otherwise(default) if has_categories else F.lit(default)

    joined = (
        requests.withColumn("category_key", F.lower("category"))
        .join(cands, "category_key", "left")
        .join(own, "model", "left")
        .withColumn("_auto", auto)
        .withColumn("matched_model", F.when(F.col("_auto"), matched))
        .join(matched_policy, "matched_model", "left")
    )
    reroute = F.col("_auto") & (F.col("matched_model") != F.col("model")) & (F.col("matched_model") != "")
    first_denied = denied_types(detected, F.col("_policy"))
    default_denied = denied_types(detected, policy_literal(config, default))
    own_denied = denied_types(detected, F.col("_own_policy"))
    staged = (
        joined.withColumn("_reroute", F.coalesce(reroute, F.lit(False)))
        .withColumn("_denied", F.when(F.col("_reroute"), first_denied).when(F.col("model") != AUTO_MODEL, own_denied))
        .withColumn("_refused", F.coalesce(F.size("_denied") > 0, F.lit(False)))
        .withColumn("_fallback", F.col("_reroute") & F.col("_refused") & (category != ""))
        .withColumn("_alternative", F.when(F.col("_fallback"), best_allowed(F.col("candidates"), detected)))
        .withColumn("_last_denied", F.when(F.col("_fallback") & F.col("_alternative").isNull(), default_denied))
    )
    fallback_fails = F.coalesce(F.size("_last_denied") > 0, F.lit(False))
    blocked = F.when(F.col("_fallback"), fallback_fails).otherwise(F.col("_refused"))
    target = (
        F.when(F.col("_fallback"), F.coalesce("_alternative", F.lit(default)))
        .when(F.col("_reroute"), F.col("matched_model"))
        .otherwise(F.col("model"))
    )
    hit = F.col("cached_body").isNotNull() if "cached_body" in requests.columns else F.lit(False)
    outcome = (
        F.when(~F.col("ok"), "invalid")
        .when(F.col("jailbreak").isNotNull(), "jailbreak_blocked")
        .when(hit, "cache_hit")
        .when(F.col("_blocked"), "pii_blocked")
        .when(F.col("_reroute"), "routed")
        .otherwise("passed")
    )
    routing = F.col("outcome").isin("routed", "passed", "pii_blocked")
    classified = F.when(routing & F.col("_auto") & (category != "") & F.lit(has_categories), F.when(F.col("_fallback"), 2).otherwise(1)).otherwise(0)
    decided = (
        staged.withColumn("_blocked", blocked)
        .withColumn("_target", target)
        .withColumn("outcome", outcome)
        .withColumn("served_model", F.when(F.col("outcome").isin("routed", "passed"), F.col("_target")))
        .withColumn("blocked_model", F.when(F.col("outcome") == "pii_blocked", F.col("_target")))
        .withColumn(
            "denied",
            F.when(F.col("outcome") == "pii_blocked", F.coalesce("_last_denied", "_denied")).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .withColumn("times_classified", classified.cast("int"))
    )
    return decided.select(
        *requests.columns, "matched_model", "outcome", "served_model", "blocked_model", "denied", "times_classified"
    )


def with_replies(decided: DataFrame, created: Column) -> DataFrame:
    """Add the immediate ``reply`` of ended requests and the ``rewritten_body`` of routed ones."""
    outcome = F.col("outcome")
    cached = F.col("cached_body") if "cached_body" in decided.columns else F.lit(None).cast("string")
    reply = (
        F.when(outcome == "pii_blocked", chat.pii_reply(F.col("blocked_model"), F.col("denied"), created))
        .when(outcome == "jailbreak_blocked", chat.guard_reply(F.col("jailbreak.type"), F.col("jailbreak.confidence"), created))
        .when(outcome == "cache_hit", chat.cache_reply(cached))
    )
    rewritten = F.when(outcome == "routed", chat.rewrite_request(F.col("served_model"), F.col("messages")))
    return decided.withColumn("reply", reply).withColumn("rewritten_body", rewritten)


@dataclass
class CacheSource:
    """Where cached answers come from, and the columns that tie requests to them.

    ``entries`` has ``entry_id, model, <vector>, response_ts, response_body``.
    """

    entries: DataFrame
    options: CacheOptions
    request_id: str
    request_ts: str
    vector: str = "embedding"
    expire: str = "on_read"


def answer_from_cache(requests: DataFrame, source: CacheSource) -> DataFrame:
    """Add ``cached_body`` to screened requests; NULL for a miss.

    Only requests that reach the cache are searched: valid, not blocked by the prompt
    guard, and with a user text. The search itself moves ids and vectors, no texts.
    """
    reaching = requests.filter(F.col("ok") & F.col("jailbreak").isNull() & (F.col("user_content") != ""))
    entries = source.entries.withColumnRenamed(source.vector, "_entry_vector")
    found = cache.lookup(
        reaching.select(source.request_id, "model", source.request_ts, F.col(source.vector).alias("_entry_vector")), entries,
        source.options, source.request_id, "entry_id", "model", "_entry_vector", source.request_ts, "response_ts", source.expire,
    )
    answers = entries.select(F.col("entry_id").alias("match_id"), F.col("response_body").alias("cached_body"))
    hits = found.filter("hit").select(source.request_id, "match_id").join(answers, "match_id").drop("match_id")
    return requests.join(hits, source.request_id, "left")


def route_requests(
    raw: DataFrame,
    config: RouterConfig,
    category_scorer: Scorer,
    pii_scorer: Scorer | None = None,
    guard_scorer: Scorer | None = None,
    category_input: str = "text",
    body: str = "body",
    created: Column | None = None,
    labels: list[str] | None = None,
    cache_source: CacheSource | None = None,
    **dims: DataFrame,
) -> DataFrame:
    """Parse, screen, look up, classify, decide and reply.

    Without ``cache_source`` every step is a projection or a lookup in a dimension, so
    the same plan runs on a table or a stream; streams use ``streaming.state`` as cache.
    """
    parsed = parse_requests(raw, body)
    screened = screen_requests(parsed, "contents", pii_scorer or PiiRules(), guard_scorer or GuardRules(), config)
    if cache_source is not None:
        # Screened once and written: the search and the decision both read it.
        screened = answer_from_cache(cut_lineage(screened, "screened"), cache_source)
    scored = screened.withColumn("_scored", category_scorer.score(F.col(category_input)))
    # Evaluate the model once per row, then only read its result.
    category = category_decision(F.col("_scored"), labels or CATEGORY_LABELS, config.category_threshold)
    classified = scored.withColumn("category", category).drop("_scored")
    decided = decide(classified, config, **dims)
    return with_replies(decided, F.unix_timestamp() if created is None else created)
