"""A training corpus in five stages.

Each stage works on all that the one before kept, written as Parquet and read again. The
first four return the columns of their input; the last one the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelane.llm import bpe, mixture, simhash, suffix_index, toxicity
from gatelane.llm.common import numbered, prepare, table, written

# Passages of 50 words and more: of those that repeat in the given tables one in a thousand is shorter.
REPEAT_BYTES = 240


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, calls toxic go."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays: that with the smallest identifier.

    Rows without identifier come last in that order. Of rows equal in identifier and text
    one stays, that whose other columns come first as JSON.
    """
    prepare(spark)
    inner, (ident, text) = numbered(docs, "doc_id", "text")
    # Two hashes name a unit: a single one would confuse a few of 10^9 documents, and drop them.
    units = {"u1": F.xxhash64(F.lit(1), ident, text), "u2": F.xxhash64(F.lit(2), text, ident)}
    unit = F.struct(*(c.alias(name) for name, c in units.items()))
    who = F.struct(F.col(ident).isNull().alias("nameless"), F.col(ident).alias("ident"), unit.alias("unit"))
    placed = simhash.near_duplicates(inner.select(who.alias("who"), F.col(text).alias("text")), "who")
    kept = placed.filter("doc_id = component_id").select("doc_id.unit.*").distinct()
    others = F.to_json(F.struct(F.lit(0), *(c for c in inner.columns if c != text)))
    one = inner.withColumns(units).groupBy(*units).agg(F.min_by(F.struct(*inner.columns), others).alias("row"))
    # Both sides grow with the documents: one plan at every size.
    return one.join(kept.hint("merge"), list(units), "left_semi").select("row.*").toDF(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT_BYTES`` that repeat are cut out of the texts; ``n_chars`` follows. Characters cut in two go."""
    prepare(spark)
    return suffix_index.cut_texts(docs, span=REPEAT_BYTES)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word are not taken."""
    prepare(spark)
    return mixture.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row left."""
    prepare(spark)
    return bpe.encode(docs)


STAGES = [
    ("toxicity", clean),
    ("simhash", distinct),
    ("suffix_repeats", without_repeats),
    ("mixture", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


# Trained scores and tokenizer merges have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None
