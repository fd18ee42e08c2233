"""Target-distribution importance resampling with bit-sliced weights.

Words are hashed into ``BUCKETS`` buckets. Corpus and target are counted over all their texts; the gain of
a bucket is its scaled, floored log ratio. A document's weight is the sum of the gains of its words. It is
computed on bit planes: the counts of a document's buckets become one ``BUCKETS``-bit plane per binary digit, the
gains one plane per digit in two's complement; every pair of planes is ANDed and its set bits counted, and the counts
added with their power of two, that of the gains' sign plane negative. All integers, so the weight is exact.

Only the two counts per bucket (a fixed number) reach the driver; the gain planes (some 20 KB) travel with the
scoring function. The draw ranks by key ranges: no window spans more than one range.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
WORDS = -(-BUCKETS // 64)
_fold = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII."""
    return (text or b"").translate(_fold).split()


def buckets_of(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, found), np.int64, len(found)) % BUCKETS


def bucket_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``bucket, n`` over all rows; at most ``BUCKETS`` rows per task are shuffled."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                found = words(value)
                if found:
                    np.add.at(counts, buckets_of(found), 1)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], ["bucket", "n"])

    return texts.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> list[int]:
    out = [0] * BUCKETS
    for row in counts.collect():  # BUCKETS rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket."""
    whole, aim = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aim))) for s, t in zip(corpus, target)], np.int64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Two's complement digits of the gains, lowest first, the sign plane last: (digits, WORDS) of 64 bits."""
    digits = int(np.abs(gain).max()).bit_length() + 1
    bits = np.zeros((digits, WORDS * 64), np.uint8)
    for j in range(digits):
        bits[j, : len(gain)] = (gain >> j) & 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def sliced_weights(rows: np.ndarray, buckets: np.ndarray, n: int, planes: np.ndarray) -> np.ndarray:
    """Weight of each of ``n`` documents, given the document and the bucket of every word."""
    out = np.zeros(n, np.int64)
    cells, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
    i = 0
    while len(cells):
        mine = (counts >> i) & 1 == 1
        doc, bucket = cells[mine] // BUCKETS, cells[mine] % BUCKETS
        if len(doc):
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            place = (np.cumsum(fresh) - 1) * WORDS + (bucket >> 6)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            plane = np.zeros(int(fresh.sum()) * WORDS, np.uint64)
            plane[place[starts]] = np.bitwise_or.reduceat(np.uint64(1) << (bucket & 63).astype(np.uint64), starts)
            plane = plane.reshape(-1, WORDS)
            for j, digit in enumerate(planes):
                part = np.bitwise_count(plane & digit).sum(axis=1, dtype=np.int64) << (i + j)
                out[doc[fresh]] += -part if j == len(planes) - 1 else part
        left = counts >> (i + 1) > 0
        cells, counts, i = cells[left], counts[left], i + 1
    return out


def weights(docs: DataFrame, gain: np.ndarray, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight`` per row; a text without words weighs nothing."""
    planes = gain_planes(gain)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [words(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            buckets = np.concatenate([buckets_of(f) for f in found]) if found else np.zeros(0, np.int64)
            weight = sliced_weights(np.repeat(np.arange(len(found)), sizes), buckets, len(found), planes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(weight)], ["doc_id", "n_features", "weight"])

    return docs.select(ident, text).mapInArrow(run, f"doc_id {kind}, n_features bigint, weight bigint")


def noise(ident: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, drawn from a hash of the identifier (null: empty)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """``scored(doc_id, ..., score)`` with ``rank``: 1, 2, 3 ... for the drawn rows, null for the others.

    floor(percent / 100) of the eligible rows are drawn, highest score first, ties by identifier (null last).
    ``scored`` must be a written table. Rows are cut into ranges of that order, as many as the session has shuffle
    partitions; a range knows its first rank from the sizes of those before it, and only ranges that hold drawn rows are ranked. Equal rows may
    fall into neighbouring ranges, so their number does not matter.
    """
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    candidates = scored.filter(eligible).withColumn("_tie", F.monotonically_increasing_id())
    placed = written(candidates.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dict(map(tuple, placed.groupBy("_range").agg(F.count("*")).collect()))  # one row per range
    wanted, first, before = sum(sizes.values()) * percent // 100, {}, 0
    for part in sorted(sizes):
        if before < wanted:
            first[part] = before
        before += sizes[part]
    offsets = F.create_map(*[F.lit(x) for pair in first.items() for x in pair]) if first else None
    none = F.lit(None).cast("bigint")
    inside = F.col("_range").isin(list(first))
    left = scored.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", none)
    beyond = placed.filter(~inside).drop("_tie", "_range").withColumn("rank", none)
    if offsets is None:
        return left.unionByName(beyond)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + offsets[F.col("_range")]
    ranked = placed.filter(inside).withColumn("rank", place.cast("bigint"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("_tie", "_range")
    return left.unionByName(beyond).unionByName(ranked)


def resample(
    docs: DataFrame, target: DataFrame, ident: str = "doc_id", text: str = "text", target_text: str = "text",
    least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``.

    Null and empty texts have no features and weight zero. Repeated rows are rows of their own; a null
    identifier draws the noise of an empty one and loses ties. Empty tables count as no features, which leaves all
    gains what smoothing makes of them. Other columns are not read.
    """
    gain = gains(_dense(bucket_counts(docs, text)), _dense(bucket_counts(target, target_text)))
    scored = weights(docs, gain, ident, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return draw(written(scored, "importance"), F.col("n_features") >= least, percent)
