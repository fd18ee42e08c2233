"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in parts by a seeded hash. How many rows of each part go to each shard is drawn
exactly from the multivariate hypergeometric law, given the sizes of parts and shards:
the law a uniform shuffle of all rows would give. Each part is permuted by a seeded hash and
dealt out by those counts; after the exchange each shard is permuted again, in cells whose
counts give every row a gapless slot.

The matrix has one row per part (the parts grow with the table, ``part_rows`` each) and one
column per shard; it is made of counts only and drawn in two levels, which is the same law: the driver deals the shards out to
groups of parts, as many as the square root of the parts, and a task per group deals its share out to the group's parts.
No window spans more than a part or a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blank, written

LAW = "rows"


_LIBRARY_LIMIT = 10**9  # of numpy's hypergeometric sampler
_SIGMAS = 12  # less than 1e-30 of the law lies further out than this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good, for any totals up to 2**53.

    Large totals are drawn by inversion: probabilities relative to the most likely count follow from the exact ratios of
    neighbouring counts, over all counts within ``_SIGMAS`` standard deviations.
    """
    whole = good + bad
    if whole < _LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn)) if whole else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    top = min(max((drawn + 1) * (good + 1) // (whole + 2), low), high)
    share = good / whole
    reach = int(_SIGMAS * (drawn * share * (1 - share) * (whole - drawn) / (whole - 1)) ** 0.5) + 50
    low, high = max(low, top - reach), min(high, top + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    heights = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(heights - heights.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], "right"))


def communication_matrix(parts: np.ndarray, shards: np.ndarray, seed: int | tuple[int, ...]) -> np.ndarray:
    """Exact part-to-shard counts: row sums are ``parts``, column sums are ``shards``."""
    rng = np.random.default_rng(seed)
    left, out = [int(x) for x in shards], np.zeros((len(parts), len(shards)), np.int64)
    for i, n in enumerate(parts):
        open_rows, drawn = sum(left), int(n)
        for j in range(len(left) - 1):
            open_rows -= left[j]
            taken = hypergeometric(rng, left[j], open_rows, drawn)
            out[i, j], drawn = taken, drawn - taken
        out[i, -1] = drawn
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def part_cuts(counts: DataFrame, total: int, shards: int, seed: int, groups: int) -> DataFrame:
    """``_part, _upto``: running shard counts of every part of ``counts(_part, _n)``."""
    grouped = counts.withColumn("_group", F.pmod("_part", F.lit(groups)).cast("int"))
    sizes = dict(map(tuple, grouped.groupBy("_group").agg(F.sum("_n")).collect()))  # the square root of the parts
    filled = sorted(sizes)
    matrix = communication_matrix(np.array([sizes[g] for g in filled], np.int64), shard_sizes(total, shards), seed)
    shares = {g: matrix[i].tolist() for i, g in enumerate(filled)}

    def deal(group: tuple, rows: pa.Table) -> pa.Table:
        g = group[0].as_py()
        rows = rows.sort_by("_part")
        upto = communication_matrix(rows["_n"].to_numpy(), np.array(shares[g], np.int64), (seed, g)).cumsum(axis=1)
        return pa.table({"_part": rows["_part"], "_upto": pa.array(list(upto), pa.list_(pa.int64()))})

    return grouped.groupBy("_group").applyInArrow(deal, "_part int, _upto array<bigint>")


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Counts at most one apart."""
    return np.array([n // shards + (i < n % shards) for i in range(shards)], np.int64)


def _cells(key: Column, cells: int) -> Column:
    return F.pmod(F.shiftright(key, 20), F.lit(cells)).cast("int")


def assign(rows: DataFrame, keys: list[str], shards: int = 8, seed: int = 7, part_rows: int = 20_000, least_parts: int = 512) -> DataFrame:
    """``keys, shard, slot`` for every row: shards 0 to ``shards`` - 1, slots 0 to the shard's rows - 1.

    ``keys`` are the columns kept and hashed; nulls are hashed like values. Rows that agree in
    all of them are numbered first (from counts, not in a window), so that any number of
    repeated rows spreads evenly. Shards differ by at most one row; an empty table stays empty.
    The result depends on the rows, ``shards``, ``seed`` and the two part parameters, not on the layout.
    """
    copies = rows.groupBy(*keys).agg(F.count("*").alias("_copies"))
    numbered = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    draw = lambda i: F.xxhash64(*[F.col(k) for k in keys], F.col("_copy"), F.lit(seed), F.lit(i))
    numbered = written(numbered.withColumns({"_h": draw(1), "_again": draw(2)}).drop("_copy"), "numbered")
    total = numbered.count()
    parts = max(least_parts, -(-total // part_rows))
    dealt = numbered.withColumn("_part", _cells(F.col("_h"), parts))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    cuts = written(part_cuts(counts, total, shards, seed, math.isqrt(parts) + 1), "cuts")
    inside = Window.partitionBy("_part").orderBy("_h", "_again", *keys)
    placed = written(
        dealt.withColumn("_rank", F.row_number().over(inside))
        .join(cuts, "_part")
        .withColumn("shard", F.size(F.filter("_upto", lambda u: u < F.col("_rank"))))
        .select(*keys, "_again", "_h", "shard"),
        "dealt",
    ).withColumn("_cell", _cells(F.col("_again"), max(1, parts // shards)))
    fill = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = fill.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("shard", "_cell").orderBy("_again", "_h", *keys)
    return (
        placed.withColumn("_rank", F.row_number().over(order))
        .join(starts, ["shard", "_cell"])
        .select(*keys, "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot"))
    )


def text_rows(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32``: what the assignment needs of a document; null texts count as empty."""
    return docs.select(
        F.col(ident).alias("doc_id"),
        (F.octet_length(blank(text)) + 1).cast("long").alias("size"),
        F.crc32(blank(text).cast("binary")).alias("text_crc32"),
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 7, part_rows: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per document, by the law ``rows``.

    Texts are read once for their size and checksum and are not moved. ``grown_shard`` is
    null: a uniform shuffle deals anew when the number of shards changes.
    """
    placed = assign(text_rows(docs), ["doc_id", "size", "text_crc32"], shards, seed, part_rows)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
