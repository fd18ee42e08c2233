"""Choosing a model: quality and load-aware ranking, latency estimates, in-flight load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import (
    UNKNOWN_BATCH, UNKNOWN_CONTEXT, UNKNOWN_PARAMS, RouterConfig, models_table, scores_table,
)
from .policy import denied_types, policies
from .prefix import running_totals

MIN_SCORE = -1.0  # a model must beat this to be chosen


def first_categories(scores: DataFrame) -> DataFrame:
    """Keep the first of several categories whose names differ only in case."""
    first = Window.partitionBy(F.lower("category"))
    return scores.withColumn("_first", F.min("category_idx").over(first)).filter("category_idx = _first").drop("_first")


def model_parameters(names: DataFrame, models: DataFrame) -> DataFrame:
    """Parameters per model; the defaults apply only to models without any entry."""
    known = models.select("model", "param_count", "batch_size", "context_size", F.lit(True).alias("_known"))
    joined = names.join(known, "model", "left")
    pick = lambda c, default: F.when(F.col("_known"), F.coalesce(c, F.lit(0.0))).otherwise(default)
    return joined.select(
        "model",
        pick("param_count", UNKNOWN_PARAMS).alias("param_count"),
        pick("batch_size", UNKNOWN_BATCH).alias("batch_size"),
        pick("context_size", UNKNOWN_CONTEXT).alias("context_size"),
    )


def ttft_ms(params: Column, batch: Column, context: Column, flops: float, hbm: float) -> Column:
    """Time to first token: prefill compute plus one pass over the weights, in milliseconds."""
    return (2 * params * batch * context / flops + 2 * params / hbm) * 1000


def ttft_table(spark: SparkSession, config: RouterConfig, scores: DataFrame | None = None) -> DataFrame:
    """``(model, base_ttft)`` for every routed model and the default model."""
    scores = scores_table(spark, config) if scores is None else scores
    names = scores.select("model")
    if config.default_model:
        names = names.union(spark.range(1).select(F.lit(config.default_model)))
    params = model_parameters(names.distinct(), models_table(spark, config))
    ttft = ttft_ms(F.col("param_count"), F.col("batch_size"), F.col("context_size"), config.flops, config.hbm)
    return params.select("model", ttft.alias("base_ttft"))


def load_score(score: Column, base_ttft: Column, load: Column) -> Column:
    """Quality per estimated latency; an unknown or zero latency divides by one."""
    estimate = F.coalesce(base_ttft, F.lit(0.0)) * (1 + F.coalesce(load, F.lit(0)))
    return score / F.when(estimate == 0, 1.0).otherwise(estimate)


def load_aware_scores(scores: DataFrame, ttft: DataFrame, load: DataFrame) -> DataFrame:
    """Replace ``score`` by the load-aware score; ``load`` is ``(model, load)``."""
    joined = scores.join(ttft, "model", "left").join(load.select("model", "load"), "model", "left")
    return joined.withColumn("score", load_score(F.col("score"), F.col("base_ttft"), F.col("load"))).drop("base_ttft", "load")


def ranked_models(scores: DataFrame) -> DataFrame:
    """Rank per category, best first; the listed order decides ties."""
    order = Window.partitionBy("category_idx").orderBy(F.desc("score"), "pos")
    return first_categories(scores).withColumn("rank", F.row_number().over(order))


def best_models(scores: DataFrame) -> DataFrame:
    """``(category, model, score)``: the best model of each category."""
    return ranked_models(scores).filter((F.col("rank") == 1) & (F.col("score") > MIN_SCORE)).select("category", "model", "score")


def first_listed(scores: DataFrame, default_model: str, categories: DataFrame) -> DataFrame:
    """First listed model per category index; unknown or empty categories get the default."""
    heads = scores.filter("pos = 0").select("category_idx", "model")
    return categories.join(heads, "category_idx", "left").withColumn("model", F.coalesce("model", F.lit(default_model)))


def candidate_table(scores: DataFrame, models: DataFrame) -> DataFrame:
    """One row per category: its models with score and policy, best first.

    The array is as long as the category's model list, so choosing among allowed
    models is a row-local expression and needs no shuffle of the requests.
    """
    listed = first_categories(scores).join(policies(models), "model", "left")
    entry = F.struct((-F.col("score")).alias("order"), "pos", "model", "score", "policy")
    return listed.groupBy(F.lower("category").alias("category_key"), "category_idx").agg(
        F.array_sort(F.collect_list(entry), lambda a, b: _by_order(a, b)).alias("candidates")
    ).drop("category_idx")


def _by_order(a: Column, b: Column) -> Column:
    return (
        F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1)
        .when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    )


def best_candidate(candidates: Column, default_model: str) -> Column:
    """Model of the best candidate; the default without any."""
    able = F.filter(candidates, lambda c: c["score"] > MIN_SCORE)
    return F.coalesce(F.get(able, F.lit(0))["model"], F.lit(default_model))


def best_allowed(candidates: Column, detected: Column) -> Column:
    """Best candidate whose policy passes; else the first listed that passes; NULL if none does."""
    passing = F.filter(candidates, lambda c: F.size(denied_types(detected, c["policy"])) == 0)
    able = F.filter(passing, lambda c: c["score"] > MIN_SCORE)
    listed = F.array_sort(F.transform(passing, lambda c: F.struct(c["pos"].alias("pos"), c["model"].alias("model"))))
    return F.coalesce(F.get(able, F.lit(0))["model"], F.get(listed, F.lit(0))["model"])


def inflight_load(events: DataFrame, model: str, order: list, delta: Column, bucket: Column, fine: Column | None = None) -> DataFrame:
    """Add ``load``: the running count of open requests per model, never below zero.

    A decrement at zero has no effect, so the count is the running sum lifted by
    the deepest point it would have reached below zero. ``fine`` cuts buckets that
    hold very many events of one model.
    """
    scanned = running_totals(events, [model], order, delta, bucket, fine)
    load = F.col("running") - F.least(F.lit(0), F.col("running_min"))
    return scanned.withColumn("load", load.cast("int")).drop("position", "running", "running_min", "running_min_before")
