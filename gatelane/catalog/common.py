"""Shared pieces of the registered queries: table readers, fixture columns and SQL fragments.

Every query reads the whole of the given tables. Where a query needs a column the
tables lack (a requested model, a correct answer), it is derived from the row.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.similarity import LinearHead, centroids
from ..session import configure, spread
from ..settings import CATEGORY_LABELS, CATEGORY_SCORES, PII_LABELS, RouterConfig, default_config

HEAD_SCALE = 20.0
REQUEST_MODELS = ["phi4", "gemma3:27b", "mistral-small3.1", "unlisted-model"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fixture_config() -> RouterConfig:
    """The shipped routing table with one model open to all types, so that rerouting can happen."""
    return default_config().with_model("gemma3:27b", allow_by_default=True)


def requested_model(ident: Column) -> Column:
    """Three of four requests ask for automatic choice, the others name a model."""
    named = F.element_at(F.array(*[F.lit(m) for m in REQUEST_MODELS]), ((F.floor(ident / 4) % 4) + 1).cast("int"))
    return F.when(ident % 4 != 0, "auto").otherwise(named)


def request_body(model: Column, messages: Column) -> Column:
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(0.7).alias("temperature")))


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request body per document, with a prompt vector."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    count = vectors.count()
    body = request_body(requested_model(F.col("doc_id")), F.array(message(F.lit("user"), F.col("text"))))
    keyed = docs.select("doc_id", body.alias("body"), (F.col("doc_id") % count).alias("vec_id"))
    return keyed.join(vectors, "vec_id").drop("vec_id")


def centroid_head(spark: SparkSession, sf_dir: str) -> LinearHead:
    return LinearHead.from_centroids(
        centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id", 5), scale=HEAD_SCALE
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per turn: the previous turn, if any, and the turn itself.

    Turns meet their predecessor through an equi-join on unique keys, so a very
    long conversation is not gathered anywhere.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    previous = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"), message(F.col("role"), F.col("text")).alias("prev")
    )
    both = turns.join(previous, ["conv_id", "turn"], "left")
    messages = F.array_compact(F.array(F.col("prev"), message(F.col("role"), F.col("text"))))
    return both.select("conv_id", "turn", requested_model(F.col("conv_id")).alias("model"), messages.alias("messages"))


# ------------------------------------------------------------------ SQL fragments
def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_values(rows) -> str:
    cell = lambda v: sql_text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


SQL_SCORES = "scores(category_idx, category, pos, model, score) AS (SELECT * FROM (VALUES %s))" % sql_values(
    (ci, cat, pos, model, score)
    for ci, (cat, scores) in enumerate(CATEGORY_SCORES.items())
    for pos, (model, score) in enumerate(scores)
)
SQL_POLICY = "policy(model, allow_all, allowed) AS (SELECT * FROM (VALUES %s))" % ", ".join(
    f"({sql_text(name)}, {str(p.allow_by_default).lower()}, {sql_list(p.allowed_pii)})"
    for name, p in fixture_config().models.items()
)
SQL_CATEGORY_LABELS = "labels_cat(idx, label) AS (SELECT * FROM (VALUES %s))" % sql_values(enumerate(CATEGORY_LABELS))
SQL_PII_LABELS = "labels_pii(idx, label) AS (SELECT * FROM (VALUES %s))" % sql_values(enumerate(PII_LABELS))
SQL_MODEL = (
    "CASE WHEN {id} % 4 <> 0 THEN 'auto' ELSE " + sql_list(REQUEST_MODELS) + "[((({id} // 4) % 4) + 1)::INT] END"
)
SQL_CENTROIDS = """
first_vecs AS (
  SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
dims AS (
  SELECT label, i AS dim, avg(embedding[i]::DOUBLE) AS m
  FROM first_vecs, range(1, 65) r(i) WHERE rn <= 5 GROUP BY ALL),
cents AS (SELECT label, list(m ORDER BY dim) AS c FROM dims GROUP BY label)"""
SQL_HEAD = SQL_CENTROIDS + """,
unit AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS w FROM cents),
logits AS (
  SELECT e.vec_id, u.label, %s * list_dot_product(e.embedding::DOUBLE[], u.w) AS z FROM embeddings e, unit u),
head AS (
  SELECT vec_id, max_by(label, (z, label)) AS class, 1.0 / sum(exp(z - zmax)) AS confidence
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS zmax FROM logits) GROUP BY vec_id)""" % HEAD_SCALE


def without_default(config: RouterConfig) -> RouterConfig:
    return replace(config, default_model="")
