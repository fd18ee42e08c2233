"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. The 64 bits are cut into five blocks. Two fingerprints that differ in at most
three bits agree in at least two whole blocks, so every such pair meets in one of the ten
two-block buckets (about 26 bits each), where the Hamming distance is verified.

Equal fingerprints are collapsed before the blocks, so groups of exact copies never meet
pairwise. Bucket sizes are counted first: rows alone in their bucket go no further, and
a bucket above ``PIECE`` rows is cut into pieces that meet pair by pair in different tasks.
A task links what it verified by stars, not by all pairs; the links are closed
transitively by ``graph.components``.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

BLOCKS = (13, 13, 13, 13, 12)
PIECE = 256
SEED = 42


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; zero without a word.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and 0x09-0x0D.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row; a null text counts as empty."""
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = [fingerprint_of(t or b"", width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(ident).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _linked(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars over the values that ``radius`` or fewer differing bits connect."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    out, free = [], np.ones(len(values), bool)
    for start in range(len(values)):
        if not free[start]:
            continue
        free[start], stack = False, [start]
        while stack:
            fresh = np.flatnonzero(near[stack.pop()] & free)
            free[fresh] = False
            stack.extend(fresh.tolist())
            out.extend((start, f) for f in fresh.tolist())
    return out


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct longs ``fp`` at ``radius`` (at most 3) or fewer differing bits."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("five blocks guarantee two shared ones up to three differing bits")
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    masks = [((1 << n) - 1) << s for n, s in zip(BLOCKS, shifts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [
        F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(signed(masks[x] | masks[y]))).alias("bits"))
        for i, (x, y) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.slot", "k.bits")
    sizes = rows.groupBy("slot", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    met = (
        rows.join(sizes, ["slot", "bits"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .groupBy("slot", "bits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("fps")
    )

    def link(batches):
        for batch in batches:
            column, found = batch.column(0), []
            flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            base = at[0]
            for i in range(len(at) - 1):
                values = flat[at[i] - base : at[i + 1] - base]
                whole = values.view(np.uint64)
                found.extend((int(values[x]), int(values[y])) for x, y in _linked(whole, radius))
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return met.mapInArrow(link, "a bigint, b bigint")


def hex_print(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest identifier reachable over links of ``radius`` or fewer
    differing bits, the document's own included. Null and empty texts and texts
    without a word have fingerprint zero and link like any other. Rows with a null
    identifier take part; a component without any identifier has a null ``component_id``.
    Repeated rows come back as often as they came. Other columns are not read.
    """
    prints = written(fingerprints(docs, ident, text, width), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = components(near_links(distinct.select("fp"), radius))
    named = distinct.join(placed.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = named.join(lowest, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")
