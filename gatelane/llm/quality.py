"""Quality rules: base counts, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets. Two multinomials
over the buckets are counted over all documents: one of the raw corpus, one of the trusted
target (the documents whose label says so). A document's verdict is the mean, over its
n-grams, of the log-likelihood ratio between target and corpus, so that long and short
documents compare; it is kept when that mean reaches a fixed threshold. No sampling: the
same document always gets the same verdict.

Counting sends at most one row per bucket and task through the shuffle; the two counts of each
bucket (a fixed number) reach the driver and travel with the scoring function. The corpus is
counted where it is read. Only texts that a bloom filter of the trusted identifiers lets
through are moved to meet those identifiers exactly; the filter has at most ``BLOOM_BITS``
bits, so beyond some ten million trusted identifiers it lets more through and loses none.
"""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
LEAST = -0.12  # mean log-likelihood ratio per n-gram that a kept document reaches
WINDOW = 5
BLOOM_BITS = 1 << 26
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"


def _word_crcs(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def ngram_buckets(crcs: np.ndarray) -> np.ndarray:
    """Buckets of all words, then of all pairs of neighbours."""
    mixed = lambda h: (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return np.concatenate([mixed(crcs), mixed(crcs[:-1] * np.uint64(0x100000001B3) + crcs[1:] + np.uint64(1 << 33))]).astype(np.int64)


def repeated_words(words: list[bytes], crcs: np.ndarray, width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + crcs[i : i + n]
    order = np.sort(key)
    same = order[1:][order[1:] == order[:-1]]
    if not len(same):
        return 0
    # Equal hashes only name candidates; the words decide.
    places = np.flatnonzero(np.isin(key, same))
    windows = {i: tuple(words[i : i + width]) for i in places.tolist()}
    often = Counter(windows.values())
    inside = np.zeros(len(words) + 1, np.int64)
    for i, w in windows.items():
        if often[w] > 1:
            inside[i] += 1
            inside[i + width if i + width < len(inside) else -1] -= 1
    return int((np.cumsum(inside)[:-1] > 0).sum())


def base_counts(text: bytes, words: list[bytes], crcs: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(bytes([c])) for c in _SPACE)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words, crcs)


def _texts(batch, at):
    for text in batch.column(at).cast(pa.binary()).to_pylist():
        yield text or b""


@contextmanager
def bloom_joins(spark: SparkSession):
    """Joins planned and run inside shuffle, their larger side filtered by a bloom filter of the smaller one, at every size."""
    bloom = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {
        bloom + "enabled": "true", bloom + "applicationSideScanSizeThreshold": "0", bloom + "creationSideThreshold": "1g",
        bloom + "maxNumBits": str(BLOOM_BITS), bloom + "expectedNumItems": str(BLOOM_BITS // 8), bloom + "maxNumItems": str(BLOOM_BITS // 8),
        "spark.sql.autoBroadcastJoinThreshold": "-1",  # a join that could be a broadcast gets no filter
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``bucket, n``: n-grams of all rows."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in _texts(batch, 0):
                words = value.split()
                if len(words) > 2000:
                    counts += np.bincount(ngram_buckets(_word_crcs(words)), minlength=BUCKETS)
                elif words:
                    np.add.at(counts, ngram_buckets(_word_crcs(words)), 1)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], ["bucket", "n"])

    per_task = docs.select(text).mapInArrow(run, "bucket bigint, n bigint")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def trusted_rows(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", mark: str = "quality") -> DataFrame:
    """Text of every row whose identifier has a label row with ``mark`` 1."""
    trusted = labels.filter(F.col(mark) == 1).select(F.col(ident).alias("_ident"))
    # One plan at every size: the labels grow with the documents, so neither side is broadcast.
    return docs.select(F.col(ident).alias("_doc"), text).join(trusted.hint("merge"), F.col("_doc") == F.col("_ident"), "left_semi").select(text)


def ratios(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """Log-likelihood ratio target to corpus per bucket, both smoothed towards the corpus by one count a bucket.

    Without a trusted document all ratios are zero.
    """
    both = np.zeros((2, BUCKETS))
    for side, counts in enumerate((raw, target)):
        found = counts.toArrow()  # BUCKETS rows at most
        both[side, found["bucket"].to_numpy()] = found["n"].to_numpy()
    corpus = (both[0] + 1) / (both[0].sum() + BUCKETS)
    if not both[1].sum():
        return np.zeros(BUCKETS)
    target = (both[1] + BUCKETS * corpus) / (both[1].sum() + BUCKETS)
    return np.log(target / corpus)


def likelihood_filter(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", mark: str = "quality", least: float = LEAST) -> DataFrame:
    """One row per document: identifier, base counts, ``base_failed``, ``ratio``, ``kept``.

    A document is trusted if any label row of its identifier has ``mark`` 1. Null and
    empty texts have no words, fail the base rules and have ratio zero. A row without identifier
    is never trusted. Repeated rows stay. Other columns are not read.
    """
    spark = docs.sparkSession
    with bloom_joins(spark):
        found = ratios(bucket_counts(docs, text), bucket_counts(trusted_rows(docs, labels, ident, text, mark), text))
    weights = spark.sparkContext.broadcast(found)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        ratio = weights.value
        for batch in batches:
            rows = []
            for value in _texts(batch, 1):
                words = value.split()
                crcs = _word_crcs(words)
                score = float(ratio[ngram_buckets(crcs)].mean()) if words else 0.0
                rows.append((*base_counts(value, words, crcs), score))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"],
            )

    counted = docs.select(F.col(ident).alias("doc_id"), text).mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double",
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least))
