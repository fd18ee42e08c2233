"""Scorer and embedder hooks: the only places where a model meets the data.

A scorer maps a column to ``struct<class INT, confidence DOUBLE>``; an embedder
adds a unit-vector column. Anything with the same method fits, for example a user
``pandas_udf`` wrapped in ``ColumnScorer``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..settings import PII_LABELS
from .similarity import LinearHead


class Scorer(Protocol):
    def score(self, value: Column) -> Column: ...


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class ColumnScorer:
    """Wraps any column function, including a pandas or Arrow UDF."""

    def __init__(self, fn: Callable[[Column], Column]):
        self.score = fn


class Precomputed:
    """Class and confidence that are already columns of the table."""

    def __init__(self, class_col: str, confidence_col: str):
        self._cols = class_col, confidence_col

    def score(self, value: Column) -> Column:
        cls, confidence = self._cols
        return F.struct(F.col(cls).cast("int").alias("class"), F.col(confidence).cast("double").alias("confidence"))


class PiiRules:
    """Pattern families; needs no model."""

    def score(self, value: Column) -> Column:
        return rules.pii_class(value, {label: i for i, label in enumerate(PII_LABELS)})


class GuardRules:
    def score(self, value: Column) -> Column:
        return rules.guard_class(value)


class ModelScorer:
    """A fitted Spark ML pipeline with a probability column."""

    def __init__(self, model, text: str = "text"):
        self.model, self.text = model, text

    def transform(self, df: DataFrame, out: str = "scored") -> DataFrame:
        probability = vector_to_array(F.col("probability"))
        # array_position finds the first maximum; ties go to the lowest index here.
        best = F.array_max(probability)
        scored = F.struct((F.array_position(probability, best) - 1).cast("int").alias("class"), best.alias("confidence"))
        before = df.columns
        return self.model.transform(df).withColumn(out, scored).select(*before, out)


class ExistingVectors:
    """Vectors that are already a column."""

    def __init__(self, column: str):
        self.column = column

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return df.withColumn(out, F.col(self.column))


class TextVectors:
    """Unit-length text vectors from hashed TF-IDF or averaged word vectors."""

    def __init__(self, kind: str = "tfidf", size: int = 256, seed: int = 42):
        if kind not in ("tfidf", "word2vec"):
            raise ValueError("kind is tfidf or word2vec")
        self.kind, self.size, self.seed, self.model = kind, size, seed, None

    def fit(self, df: DataFrame, text: str) -> "TextVectors":
        split = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\s+")
        if self.kind == "tfidf":
            stages = [split, HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=self.size), IDF(inputCol="_tf", outputCol="_raw")]
        else:
            stages = [split, Word2Vec(inputCol="_tokens", outputCol="_raw", vectorSize=self.size, minCount=1, seed=self.seed)]
        self.model = Pipeline(stages=[*stages, Normalizer(inputCol="_raw", outputCol="_unit")]).fit(df)
        return self

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        if self.model is None:
            self.fit(df, text)
        return self.model.transform(df).withColumn(out, vector_to_array("_unit")).select(*df.columns, out)


__all__ = [
    "ColumnScorer", "Embedder", "ExistingVectors", "GuardRules", "LinearHead", "ModelScorer",
    "PiiRules", "Precomputed", "Scorer", "TextVectors",
]
