"""Corpus preparation, classifier training with Spark ML, and evaluation reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import corpus, reports
from ..operators.similarity import centroids
from ..session import cut_lineage
from ..sources.sinks import side_by_side

PARTS = ("train", "validation", "test")


@dataclass
class Corpus:
    rows: DataFrame      # ident, text or vector, label, label_id, split
    labels: DataFrame    # label, label_id


def prepare_corpus(
    df: DataFrame, ident: str, label: str = "label", min_rows: int = corpus.MIN_CLASS_ROWS,
    ratios: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = PARTS, stratify: bool = True, seed: int = 42,
) -> Corpus:
    """Drop rare labels, split per label, and number the labels.

    ``stratify=False`` is the way out when some label is too thin for every part.
    """
    # Label counts are class-sized; written once, they give the rare filter and the index.
    counts = cut_lineage(df.groupBy(label).agg(F.count("*").alias("_n")), "label-counts")
    labels = corpus.label_index(counts.filter(F.col("_n") >= min_rows), label)
    # Null-safe: rows without a label form a class of their own, as in the split.
    named = labels.withColumnRenamed(label, "_named")
    kept = df.join(named, F.col(label).eqNullSafe(F.col("_named"))).drop("_named")
    return Corpus(corpus.split(kept, ident, label if stratify else None, ratios, names, seed), labels)


def text_pipeline(text: str, label: str, features: int = 1 << 14, iterations: int = 20, weight: str | None = None) -> Pipeline:
    """Tokens, hashed TF-IDF and multinomial logistic regression."""
    head = LogisticRegression(
        featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01, family="multinomial",
        **({"weightCol": weight} if weight else {}),
    )
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\s+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"), head,
    ])


def vector_pipeline(label: str, iterations: int = 20) -> Pipeline:
    return Pipeline(stages=[
        LogisticRegression(featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01, family="multinomial")
    ])


def train(train_rows: DataFrame, text: str | None = None, vector: str | None = None, label: str = "label_id", **options) -> PipelineModel:
    """Fit a classifier on a text or a vector column. The rows are written out once; fitting reads them many times."""
    value = text or vector
    rows = cut_lineage(train_rows.select(F.col(value), F.col(label).cast("double").alias(label)), "train")
    if text:
        return text_pipeline(text, label, **options).fit(rows)
    return vector_pipeline(label, **options).fit(rows.withColumn("_features", array_to_vector(vector)))


def predict(model: PipelineModel, df: DataFrame, vector: str | None = None, out: str = "predicted_id") -> DataFrame:
    """Add the predicted class and its confidence."""
    given = df.withColumn("_features", array_to_vector(vector)) if vector else df
    scored = model.transform(given)
    return scored.select(
        *df.columns, F.col("prediction").cast("int").alias(out),
        F.array_max(vector_to_array("probability")).alias("confidence"), vector_to_array("probability").alias("probability"),
    )


def named_predictions(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Predicted label by name; a class outside the vocabulary reads ``Unknown``."""
    names = labels.select(F.col("label_id").alias("predicted_id"), F.col("label").alias("predicted"))
    return predicted.join(names, "predicted_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit("Unknown")))


def history(model: PipelineModel) -> DataFrame:
    """Loss after every iteration of the fitted head."""
    losses = [float(x) for x in model.stages[-1].summary.objectiveHistory]
    spark = model.stages[-1].summary.predictions.sparkSession
    return spark.createDataFrame(list(enumerate(losses)), "iteration int, loss double")


def report(predicted: DataFrame, truth: str = "label", guess: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """Confusion counts and classification report."""
    counts = reports.confusion(predicted, truth, guess)
    return counts, reports.classification_report(counts)


def log_loss(probability: Column, label: Column) -> Column:
    return -F.log(F.greatest(F.get(probability, label), F.lit(1e-15)))


def centroid_model(df: DataFrame, label: str, vector: str, order: str, first: int = 5) -> DataFrame:
    """Mean of the first vectors per label, the nearest-centroid classifier."""
    return centroids(df, label, vector, order, first)


# ------------------------------------------------------------------ two tasks at once
@dataclass
class DualModel:
    category: PipelineModel
    words: PipelineModel


def word_rows(df: DataFrame, ident: str, text: str, labels: str) -> DataFrame:
    """One row per word with its label and a shape description the word model can learn from."""
    pairs = F.arrays_zip(texts.words(F.col(text)).alias("word"), F.col(labels).alias("flag"))
    # The outer form spares the plan an inferred filter that would split the text again.
    rows = df.select(ident, F.posexplode_outer(pairs).alias("pos", "z")).filter("pos is not null").select(ident, "pos", F.col("z.word").alias("word"), F.col("z.flag").alias("flag"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("word", r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\d", "0")
    return rows.withColumn("tokens", F.concat_ws(" ", "word", shape, F.regexp_replace(shape, r"(.)\1+", "$1")))


def train_dual(df: DataFrame, ident: str, text: str, category: str, labels: str, features: int = 1 << 12, iterations: int = 20) -> DualModel:
    """Category per text and personal-data flag per word, from the same table.

    Equal words are collapsed to one weighted row before the word model is fitted, so
    its input grows with the vocabulary and not with the corpus.
    """
    head = train(df, text=text, label=category, features=features, iterations=iterations)
    counted = word_rows(df, ident, text, labels).filter(F.col("flag") != texts.MASKED_LABEL)
    weighted = counted.groupBy("tokens", "flag").agg(F.count("*").cast("double").alias("weight"))
    rows = cut_lineage(weighted.withColumn("flag", F.col("flag").cast("double")), "words")
    return DualModel(head, text_pipeline("tokens", "flag", features, iterations, weight="weight").fit(rows))


def dual_scores(model: DualModel, df: DataFrame, ident: str, text: str, category: str, labels: str, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Losses of both heads, their weighted sum, category accuracy and weighted F1 of the flags."""
    docs = predict(model.category, df).agg(
        F.avg(log_loss(F.col("probability"), F.col(category).cast("int"))).alias("category_loss"),
        F.avg((F.col("predicted_id") == F.col(category)).cast("double")).alias("category_accuracy"),
    )
    counted = word_rows(df, ident, text, labels).filter(F.col("flag") != texts.MASKED_LABEL).groupBy("tokens", "flag").agg(F.count("*").alias("n"))
    scored = predict(model.words, counted)
    loss = scored.agg((F.sum(log_loss(F.col("probability"), F.col("flag")) * F.col("n")) / F.sum("n")).alias("pii_loss"))
    f1 = reports.weighted_f1(reports.confusion(scored, "flag", "predicted_id", F.col("n"))).select(F.col("weighted_f1").alias("pii_f1"))
    joined = side_by_side(docs, loss, f1)
    return joined.withColumn("total_loss", weights[0] * F.col("category_loss") + weights[1] * F.col("pii_loss"))
