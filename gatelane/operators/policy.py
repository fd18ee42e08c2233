"""Privacy policy: which detected types a model may not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import NO_PII, RouterConfig

POLICY = "struct<allow_by_default:boolean,allowed:array<string>>"


def denied_types(detected: Column, policy: Column) -> Column:
    """Detected types the policy denies, in detection order, repeats kept.

    A NULL policy (model without an entry) allows everything.
    """
    blocked = F.filter(detected, lambda t: (t != NO_PII) & ~F.array_contains(policy["allowed"], t))
    open_policy = policy.isNull() | policy["allow_by_default"]
    return F.when(open_policy, F.array().cast("array<string>")).otherwise(blocked)


def is_allowed(detected: Column, policy: Column) -> Column:
    return F.size(denied_types(detected, policy)) == 0


def type_allowed(pii_type: Column, policy: Column) -> Column:
    """Single-type form of the policy."""
    return policy.isNull() | policy["allow_by_default"] | F.array_contains(policy["allowed"], pii_type)


def policy_literal(config: RouterConfig, model: str) -> Column:
    """Policy of one configured model as a constant; NULL if it has none."""
    params = config.models.get(model)
    if params is None:
        return F.lit(None).cast(POLICY)
    allowed = F.array(*[F.lit(t) for t in params.allowed_pii]).cast("array<string>")
    return F.struct(F.lit(params.allow_by_default).alias("allow_by_default"), allowed.alias("allowed"))


def policies(models: DataFrame) -> DataFrame:
    """``(model, policy)`` from the model table."""
    return models.select("model", F.struct("allow_by_default", "allowed").alias("policy"))


def with_policy(df: DataFrame, models: DataFrame, model: str = "model", out: str = "policy") -> DataFrame:
    """Left join of each row's model to its policy."""
    found = policies(models).select(F.col("model").alias(model), F.col("policy").alias(out))
    return df.join(found, model, "left")


def check_policy(df: DataFrame, models: DataFrame, model: str = "model", detected: str = "detected") -> DataFrame:
    """Add ``denied`` and ``allowed`` for each row's model."""
    joined = with_policy(df, models, model, "_policy")
    return joined.withColumn("denied", denied_types(F.col(detected), F.col("_policy"))).withColumn(
        "allowed", F.size("denied") == 0
    ).drop("_policy")
