"""Labelled corpora: dominant labels, rare classes, label indices, splits, generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.texts import KNOWN_NAMES, seeded_key, seeded_pick, word_pii_labels
from ..settings import NO_PII
from .prefix import hash_cuts, sorted_positions

FEW_LABELS = 10_000  # a vocabulary up to this size is numbered on the driver

# --- Fixed values: categories, their sentences, and insertable personal data ---
TEMPLATES = {
    "math": [
        "What is the derivative of x^2?", "Solve for x: 2x + 5 = 15", "Calculate the area of a circle with radius 5",
        "Find the limit as x approaches 0", "What is the integral of sin(x)?", "Prove that the square root of 2 is irrational",
    ],
    "science": [
        "Explain photosynthesis in plants", "What are the laws of thermodynamics?", "How does DNA replication work?",
        "Describe the structure of an atom", "What causes gravity?", "Explain the theory of evolution",
    ],
    "history": [
        "When was the American Civil War?", "Who was Napoleon Bonaparte?", "What caused World War I?",
        "Describe the Renaissance period", "What was the Cold War?", "When did the Roman Empire fall?",
    ],
    "technology": [
        "How do computer processors work?", "What is artificial intelligence?", "Explain blockchain technology",
        "How does the internet work?", "What is machine learning?", "Describe quantum computing",
    ],
    "literature": [
        "Who wrote Romeo and Juliet?", "What is the theme of Moby Dick?", "Analyze the character of Hamlet",
        "Who is the author of 1984?", "What is symbolism in literature?", "Describe the Romantic period in literature",
    ],
    "geography": [
        "What is the capital of France?", "Where is the Amazon rainforest?", "What are tectonic plates?",
        "Name the largest ocean", "What causes earthquakes?", "Where is Mount Everest located?",
    ],
    "economics": [
        "What is supply and demand?", "Explain inflation and deflation", "What is GDP?",
        "How do stock markets work?", "What is fiscal policy?", "Explain the concept of opportunity cost",
    ],
    "medicine": [
        "What is diabetes?", "How does the immune system work?", "What causes heart disease?",
        "Explain how vaccines work", "What is cancer?", "How do antibiotics work?",
    ],
    "sports": [
        "What are the rules of basketball?", "Who won the last World Cup?", "How long is a marathon?",
        "What is the offside rule in soccer?", "Who holds the record for home runs?", "What sports are in the Olympics?",
    ],
    "general": [
        "What time is it?", "How are you today?", "What's the weather like?",
        "Tell me a joke", "What's for dinner?", "How was your day?",
    ],
}
PERSONAL_DATA = {
    "email": [
        "john.doe@email.com", "sarah.smith@company.org", "mike.johnson@university.edu", "anna.brown@gmail.com",
        "david.wilson@yahoo.com",
    ],
    "phone": ["123-456-7890", "(555) 123-4567", "800-555-0123", "+1-234-567-8900", "555.123.4567"],
    "name": KNOWN_NAMES,
    "address": [
        "123 Main Street, New York, NY", "456 Oak Avenue, Los Angeles, CA", "789 Pine Road, Chicago, IL",
        "321 Elm Street, Houston, TX", "654 Maple Drive, Phoenix, AZ",
    ],
    "ssn": ["123-45-6789", "987-65-4321", "555-44-3333", "111-22-3333", "999-88-7777"],
}
# {kind}, {value} and {text} are filled in.
INSERTIONS = [
    "My {kind} is {value}. {text}", "{text} Contact me at {value}.", "Hi, I'm {value}. {text}",
    "{text} You can reach me at {value}.", "From {value}: {text}",
]
INSERT_PROBABILITY = 0.3
MIN_CLASS_ROWS = 3
# ------------------------------------------------------------------------------


def dominant_label(types: Column) -> Column:
    """Most frequent entry of an array, the smallest on ties; ``NO_PII`` when empty."""
    counted = F.transform(
        F.array_distinct(types), lambda t: F.struct((-F.size(F.filter(types, lambda x: x == t))).alias("n"), t.alias("t"))
    )
    return F.coalesce(F.array_min(counted)["t"], F.lit(NO_PII))


def dominant_label_rows(spans: DataFrame, doc: str, kind: str) -> DataFrame:
    """The same for spans stored one per row: counted in two partial aggregates."""
    counts = spans.groupBy(doc, kind).agg(F.count("*").alias("_n"))
    order = F.when(F.col(kind).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(kind).alias("k")))
    best = counts.groupBy(doc).agg(F.min_by(kind, order).alias("_best"))
    return best.select(doc, F.coalesce("_best", F.lit(NO_PII)).alias("label"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def drop_rare(df: DataFrame, label: str, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """Drop labels with too few rows; a missing label is a label like others.

    Labels are counted with partial aggregates and the few rare ones removed by an
    anti join; the rows themselves are not shuffled by label.
    """
    rare = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") < min_rows).select(F.col(label).alias("_rare"))
    return df.join(rare, F.col(label).eqNullSafe(F.col("_rare")), "left_anti")


def label_index(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels with a dense index from zero; a missing label comes first.

    Up to ``FEW_LABELS`` labels are numbered on the driver, larger vocabularies in ranges. The vocabulary is counted when this is called.
    """
    vocabulary = df.select(label).distinct()
    found = [r[0] for r in vocabulary.take(FEW_LABELS + 1)]
    if len(found) > FEW_LABELS:
        return sorted_positions(vocabulary, label).select(label, F.col("position").cast("int").alias("label_id"))
    found.sort(key=lambda x: (x is not None, x))
    kind = StructType([vocabulary.schema[label], StructField("label_id", IntegerType(), False)])
    return F.broadcast(df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(found)], kind))


def split(
    df: DataFrame, ident: str, label: str | None, ratios: tuple[float, ...] = (0.7, 0.15, 0.15),
    names: tuple[str, ...] = ("train", "validation", "test"), seed: int = 42, digits: int = 3,
) -> DataFrame:
    """Add ``split``: seeded shares per label, or over all rows without a label.

    Row r of n (in seeded order) belongs to the first part whose upper share is at
    least r/n. Only the cut positions are searched for; the rows are then labelled by
    comparing their key with the cuts of their label, without a shuffle by label.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6 or len(ratios) != len(names):
        raise ValueError("ratios must sum to 1 and match the names")
    upper, percents = 0.0, []
    for ratio in ratios[:-1]:
        upper += ratio
        percents.append(round(upper * 100, 6))
    percents = [int(p) if p == int(p) else p for p in percents]
    keyed = df.withColumn("_stratum", F.lit("") if label is None else F.col(label))
    cuts = hash_cuts(keyed, "_stratum", ident, percents, seed, digits)
    if label is None:  # a single stratum has one row of cuts: constants of the plan
        row = cuts.first()
        joined = keyed.withColumns({f"cut_{i}": F.lit(row[f"cut_{i}"] if row else "") for i in range(len(percents))})
    else:
        named = cuts.withColumnRenamed("_stratum", "_of")
        joined = keyed.join(named, F.col("_stratum").eqNullSafe(F.col("_of")), "left").drop("_of")
    joined = joined.withColumn("_key", seeded_key(seed, F.col(ident)))
    part = F.lit(names[-1])
    for i in reversed(range(len(percents))):
        part = F.when(F.col("_key") <= F.col(f"cut_{i}"), names[i]).otherwise(part)
    return joined.withColumn("split", part).drop("_stratum", "_key", *[f"cut_{i}" for i in range(len(percents))])


def _choose(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def generate_corpus(ids: DataFrame, ident: str, seed: int = 42, probability: float = INSERT_PROBABILITY) -> DataFrame:
    """One labelled sentence per id: ``category``, ``text`` and 0/1 ``pii_labels`` per word.

    Every choice is a hash of seed, decision and id, so the result does not depend on
    partitioning and any id can be produced again alone.
    """
    pick = lambda slot, n: seeded_pick(seed, slot, F.col(ident), n)
    kinds = list(PERSONAL_DATA)
    base = ids.select(
        F.col(ident), pick("category", len(TEMPLATES)).alias("category"),
        (pick("insert", 10_000) < int(probability * 10_000)).alias("has_pii"),
        pick("kind", len(kinds)).alias("_kind"), pick("form", len(INSERTIONS)).alias("_form"),
    )
    sentences = [F.when(F.col("category") == i, _choose(v, pick("sentence", len(v)))) for i, v in enumerate(TEMPLATES.values())]
    values = [F.when(F.col("_kind") == i, _choose(PERSONAL_DATA[k], pick("value", len(PERSONAL_DATA[k])))) for i, k in enumerate(kinds)]
    drawn = base.withColumn("_text", F.coalesce(*sentences)).withColumn("_value", F.coalesce(*values)).withColumn("_name", _choose(kinds, F.col("_kind")))
    filled = F.replace(F.replace(F.replace(_choose(INSERTIONS, F.col("_form")), F.lit("{kind}"), F.col("_name")), F.lit("{value}"), F.col("_value")), F.lit("{text}"), F.col("_text"))
    text = drawn.withColumn("text", F.when(F.col("has_pii"), filled).otherwise(F.col("_text")))
    return text.select(ident, "category", "has_pii", "text", word_pii_labels(F.col("text")).alias("pii_labels"))
