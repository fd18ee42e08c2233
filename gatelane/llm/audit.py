"""Filter interaction audit: what each filter removes in every order of the filters.

One pass of a byte transducer (``words.Words``) counts the words, different words, capitals, code points and symbols
of a text; five rules over them and over equal texts give each document a five-bit pattern of the
filters it fails. Whatever the order, a filter sees a document unless an earlier one removed it, so all counts
follow from the number of documents per source and pattern: 32 rows per source instead of 120 passes. What a filter
removes depends only on the set before it; 80 pairs of filter and set serve all 600 steps, and the Shapley sum
weighs each set by the orders that have it in front.

Equal texts meet by SHA-256 digest. Rows are first merged per digest and identifier, then per digest and
pattern, so a text that fills a third of the table is a few rows per task before it meets itself.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, written
from .words import IS_CAPITAL, IS_POINT, IS_SYMBOL, Words

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # the last two in percent
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
# Every filter with every set of the others that may stand before it.
STEPS = [(name, before) for name in FILTERS for before in range(32) if not before & BIT[name]]


def text_facts(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, part, digest, n_words, n_distinct, capitals, code_points, symbols`` of every row."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = Words(batch.column(2))
            edges, data = found.offsets.tolist(), found.data
            digests = [sha256(data[a:b]).digest() for a, b in zip(edges, edges[1:])]
            numbers = [np.diff(found.first_word()), found.distinct(), *(found.counts(b) for b in (IS_CAPITAL, IS_POINT, IS_SYMBOL))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *(pa.array(n.astype(np.int64)) for n in numbers)],
                ["doc_id", "part", "digest", "n_words", "n_distinct", "capitals", "code_points", "symbols"],
            )

    rows = docs.select(F.col(ident).alias("doc_id"), blank(source).alias("part"), blank(text).cast("binary").alias("text"))
    return rows.mapInArrow(
        run, f"doc_id {kind}, part string, digest binary, n_words bigint, n_distinct bigint, capitals bigint, code_points bigint, symbols bigint"
    )


def patterns(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part, pattern, n, n_good, n_toxic``: documents per source and set of failed filters (bit i: the i-th filter)."""
    facts = text_facts(docs, ident, text, source)
    fails = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("code_points"),
        "D": F.col("symbols") > 0,
    }
    own = sum((F.when(rule, BIT[name]).otherwise(0) for name, rule in fails.items()), F.lit(0))
    # Rows equal in identifier, text and source count once here, with their number.
    rows = facts.groupBy("doc_id", "part", "digest", own.alias("own")).agg(F.count("*").alias("n"))
    marks = labels.filter((F.col("quality") == 1) | (F.col("toxic") == 1)).groupBy(F.col(ident).alias("_of")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic")
    )
    # One plan at every size: the labels grow with the documents, so neither side is broadcast.
    marked = rows.join(marks.hint("merge"), F.col("doc_id") == F.col("_of"), "left").drop("_of").fillna(0, ["good", "toxic"])
    cells = marked.groupBy("digest", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min_by("n", "doc_id").alias("n_low"),
    )
    # The smallest identifier of a text fails E nowhere; a row without identifier has none smaller.
    lowest = F.min("low").over(Window.partitionBy("digest"))  # rows: sources and labels of one text
    passing = F.col("nameless") + F.when(F.col("low") == lowest, F.col("n_low")).otherwise(0)
    halves = F.explode(F.array(
        F.struct(F.col("own").alias("pattern"), F.col("passing").alias("n")),
        F.struct((F.col("own") + BIT["E"]).alias("pattern"), (F.col("n") - F.col("passing")).alias("n")),
    ))
    split = cells.withColumn("passing", passing).select("part", "good", "toxic", halves.alias("h")).select("part", "good", "toxic", "h.*")
    total = lambda c: F.sum(c).cast("bigint")
    return split.groupBy("part", "pattern").agg(
        total("n").alias("n"), total(F.col("n") * F.col("good")).alias("n_good"), total(F.col("n") * F.col("toxic")).alias("n_toxic")
    )


def interactions(found: DataFrame) -> DataFrame:
    """Every order and step of the filters for each part of ``found(part, pattern, n, n_good, n_toxic)``."""
    steps = F.array(*[F.struct(F.lit(name).alias("filter"), F.lit(BIT[name]).alias("bit"), F.lit(before).alias("before")) for name, before in STEPS])
    rows = found.withColumn("s", F.explode(steps)).select("*", "s.*")
    pattern, bit, earlier = F.col("pattern"), F.col("bit"), F.col("pattern").bitwiseAND(F.col("before")) > 0
    failing = pattern.bitwiseAND(bit) > 0
    here = failing & ~earlier
    add = lambda rule, value: F.sum(F.when(rule, F.col(value)).otherwise(0)).alias
    sums = rows.groupBy("part", "filter", "before").agg(
        add(~failing & ~earlier, "n")("kept"), add(here, "n")("removed"), add(failing & earlier, "n")("redundant"),
        add(pattern == bit, "n")("unique_fails"), add(here, "n_good")("good_lost"), add(here, "n_toxic")("toxic_lost"),
    )
    size = F.bit_count("before").cast("int")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(4 - k)) for k in range(5)]), size + 1)
    shares = Window.partitionBy("part", "filter")  # 16 rows
    valued = sums.withColumn("shapley", F.sum(F.col("removed") * orders).over(shares))
    named = [
        (order, step + 1, name, sum(BIT[x] for x in order[:step])) for order in map("".join, permutations(FILTERS)) for step, name in enumerate(order)
    ]  # 600 rows
    plan = found.sparkSession.createDataFrame(named, "filter_order string, step int, filter string, before int")
    counts = [F.col(c).cast("bigint") for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    return valued.join(F.broadcast(plan), ["filter", "before"]).select("part", "filter_order", "step", *counts)


def interaction_audit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The audit of ``docs``: ``part, filter_order, step`` and the counts, 600 rows per source.

    A null text is empty, a null source the empty string. Repeated rows count as often as they occur; of equal texts those with the
    smallest identifier pass the last filter, all of them if it occurs twice, and so do rows without identifier. A
    document is good or toxic if any label row of its identifier says so; a null mark says nothing. An empty table
    has no parts. Other columns are not read.
    """
    return interactions(written(patterns(docs, labels, ident, text, source), "patterns"))
