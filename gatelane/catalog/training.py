"""Corpus preparation and classifier training on documents, labels and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import corpus
from ..operators.scorers import TextVectors
from ..plans import joint, training
from ..session import cut_lineage, scratch_path, spread
from ..sources import sinks
from .common import table
from .corpus import sql_word_labels

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare labels dropped, parts drawn per label, labels numbered."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("label"))
    return training.prepare_corpus(rows, "doc_id").rows.select("doc_id", "label", "label_id", "split")


SQL["prepare_corpus"] = """
WITH l AS (SELECT doc_id, source || '/' || lang AS label FROM documents QUALIFY count(*) OVER (PARTITION BY source, lang) >= 3),
p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id) || ':' || doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM l),
i AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM (SELECT DISTINCT label FROM l))
SELECT doc_id, label, label_id, CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'validation' ELSE 'test' END AS split FROM p JOIN i USING (label)"""


@query
def train_language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text classifier for the language of whole documents: report on validation and test part."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label")), "doc_id")
    prepared = training.prepare_corpus(docs, "doc_id")
    rows = cut_lineage(prepared.rows, "language")
    model = training.train(rows.filter("split = 'train'"), text="text", features=1 << 12, iterations=8)
    held = training.predict(model, rows.filter("split <> 'train'"))
    named = training.named_predictions(held, prepared.labels)
    parts = []
    for part in ("validation", "test"):
        _, report = training.report(named.filter(F.col("split") == part))
        parts.append(report.select(F.lit(part).alias("split"), "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"))
    return parts[0].unionByName(parts[1])


@query
def train_vector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss per iteration of a classifier on embeddings, through the history sink."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label_id"))
    model = training.train(rows, vector="embedding", iterations=10)
    path = scratch_path(spark, "history")
    sinks.save_history(training.history(model), path)
    return spark.read.schema("iteration int, loss double").json(path).select("iteration", F.round("loss", 6).alias("loss"))


@query
def text_embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit text vectors of every document from hashed TF-IDF: length and count of non-zero entries."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    vectors = TextVectors("tfidf", 128).fit(docs, "text").embed(docs, "text", "v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("doc_id", F.round(norm, 6).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("n_non_zero"))


@query
def text_embedding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of unit text vectors: length 1 or, without a word, 0, and no more entries than different words."""
    norms = text_embedding_norms(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w"))
    both = norms.join(docs, "doc_id")
    return both.select(
        "doc_id", F.coalesce(F.abs(F.col("norm") - 1) < 1e-6, F.lit(False)).alias("unit"), (F.col("n_non_zero") <= F.size("w")).alias("few"),
    )


SQL["text_embedding_facts"] = "SELECT doc_id, regexp_matches(text, '\\S') AS unit, true AS few FROM documents"


@query
def dual_task_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and word-flag model trained on generated sentences, scored on a held-out part."""
    made = corpus.generate_corpus(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    parts = cut_lineage(corpus.split(made, "doc_id", "category", (0.8, 0.2), ("train", "validation")), "dual")
    model = training.train_dual(parts.filter("split = 'train'"), "doc_id", "text", "category", "pii_labels", 1 << 10, 8)
    scores = training.dual_scores(model, parts.filter("split = 'validation'"), "doc_id", "text", "category", "pii_labels", (1.0, 0.5))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query
def train_history_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every training history: iterations in a row from the first, and a loss that never rises."""
    history = train_vector_history(spark, sf_dir)
    pairs = history.agg(F.array_sort(F.collect_list(F.struct("iteration", "loss"))).alias("h"))  # one entry per iteration
    steps = F.sequence(F.lit(1), F.size("h") - 1)
    follows = F.forall(steps, lambda i: F.get("h", i)["iteration"] == F.get("h", i - 1)["iteration"] + 1)
    falls = F.forall(steps, lambda i: F.get("h", i)["loss"] <= F.get("h", i - 1)["loss"])
    return pairs.select(follows.alias("in_a_row"), falls.alias("never_rises"), (F.size("h") > 1).alias("several"))


SQL["train_history_facts"] = "SELECT true AS in_a_row, true AS never_rises, true AS several FROM (SELECT count(*) FROM embeddings)"


@query
def train_language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support of every language in the report on held-out parts: the labels and their numbers are exact."""
    report = train_language_report(spark, sf_dir)
    return report.filter(~F.col("label").isin("accuracy", "macro avg", "weighted avg")).select("split", "label", F.col("support").cast("bigint").alias("support"))


SQL["train_language_support"] = """
WITH p AS (SELECT lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id) || ':' || doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT label, CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'validation' ELSE 'test' END AS split FROM p)
SELECT split, label, count(*) AS support FROM s WHERE split <> 'train' GROUP BY ALL"""


def _joint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with their language as category and the flags of the word rule."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    # Every language found in the data has its place; a document without one has no category.
    places = corpus.label_index(docs.filter(F.col("lang").isNotNull()), "lang")
    marked = docs.join(places, "lang", "left").withColumnRenamed("label_id", "category")
    split = marked.withColumn("words", texts.words(F.col("text")))
    flagged = split.withColumn("flags", texts.word_pii_labels(F.col("text"), F.col("words")))
    return joint.features(flagged, "doc_id", "text", "category", "flags", 1 << 11, "words")


@query
def joint_task_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-task model on the given texts, fitted by its joint loss: words and flags of every document, and whether the loss fell throughout."""
    rows = _joint_rows(spark, sf_dir)
    last = rows.agg(F.max("category")).first()[0]
    classes = 1 if last is None else last + 1
    model = joint.train_joint(rows, joint.Shape(classes, 1 << 11, 8), (1.0, 0.5), 4)
    steady = all(b < a for a, b in zip(model.history, model.history[1:])) and len(model.history) > 2
    scored = joint.joint_scores(model, rows)
    return scored.select(F.col("ident").alias("doc_id"), "n_words", (F.col("flags_right") <= F.col("n_words")).alias("within"), F.lit(steady).alias("loss_falls"))


SQL["joint_task_words"] = f"SELECT doc_id, len({sql_word_labels('text')})::BIGINT AS n_words, true AS within, true AS loss_falls FROM documents"
