"""Prefix sums and ranks that do not funnel a hot key through one task.

A window ordered over a key would send every row of that key to one task. Here each
key is first cut into buckets that respect the order (time slices, hash prefixes).
Rows are scanned inside their bucket; only one total per key and bucket is scanned
across buckets, and the result is joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import seeded_key
from ..session import cut_lineage


CELL_ROWS = 20_000  # rows of one key and bucket from which the finer bucket is used


def _sized(df: DataFrame, keys: list[str], bucket: Column, fine: Column, cell_rows: int) -> DataFrame:
    """``_bucket``: the bucket, and within those that hold more than ``cell_rows`` rows of a key the finer one."""
    coarse = df.withColumn("_coarse", bucket)
    cell = [*keys, "_coarse"]
    large = coarse.groupBy(*cell).agg(F.count("*").alias("_size")).filter(F.col("_size") > cell_rows)
    large = large.select(*[F.col(c).alias(f"_large_{i}") for i, c in enumerate(cell)], F.lit(True).alias("_large"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_large_{i}")) for i, c in enumerate(cell)])
    split = F.struct(F.col("_coarse").alias("coarse"), F.when(F.col("_large"), fine).alias("fine"))
    return coarse.join(large, same, "left").withColumn("_bucket", split).drop("_coarse", "_large", *[f"_large_{i}" for i in range(len(cell))])


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column | str], value: Column, bucket: Column,
    fine: Column | None = None, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Prefix scan of ``value`` per key.

    Adds ``position`` (1-based row number), ``running`` (inclusive prefix sum),
    ``running_min`` (minimum of the prefix sums so far) and ``running_min_before``
    (the same without the current row, NULL on the first). ``bucket`` must not
    decrease along ``order``; nor may ``fine`` within a bucket, which takes its place
    where one key has more than ``cell_rows`` rows in one bucket.
    """
    cell = [*keys, "_bucket"]
    ordered = Window.partitionBy(*cell).orderBy(*order)
    inside = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        (df.withColumn("_bucket", bucket) if fine is None else _sized(df, keys, bucket, fine, cell_rows))
        .withColumn("_value", value)
        .withColumn("_row", F.row_number().over(ordered))
        .withColumn("_sum", F.sum("_value").over(inside))
        .withColumn("_low", F.min("_sum").over(inside))
        .withColumn("_low_before", F.min("_sum").over(earlier))
    )
    totals = local.groupBy(*cell).agg(
        F.count("*").alias("_rows"), F.sum("_value").alias("_total"), F.min("_sum").alias("_lowest")
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .withColumn("_past", F.min(F.col("_base") + F.col("_lowest")).over(before))
        .select(*[F.col(c).alias(f"_cell_{i}") for i, c in enumerate(cell)], "_start", "_base", "_past")
    )
    # Null-safe: rows without a key form a group of their own. It also keeps both uses of
    # the scan free of inferred filters, so that its shuffle can be shared.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_cell_{i}")) for i, c in enumerate(cell)])
    joined = local.join(offsets, same)
    return (
        joined.withColumn("position", F.col("_start") + F.col("_row"))
        .withColumn("running", F.col("_base") + F.col("_sum"))
        .withColumn("running_min", F.least("_past", F.col("_base") + F.col("_low")))
        .withColumn("running_min_before", F.least("_past", F.col("_base") + F.col("_low_before")))
        .drop(
            "_bucket", "_value", "_row", "_sum", "_low", "_low_before", "_start", "_base", "_past",
            *[f"_cell_{i}" for i in range(len(cell))],
        )
    )


def sorted_positions(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``position``, the 0-based place of each row in the whole order, without a window over all rows.

    Rows are cut into ranges of the order, as many as the session has shuffle partitions, and written with the number of their
    range; the sizes of the ranges (one number each) give the place every range begins at, and rows are numbered inside
    theirs. Rows equal in ``order`` get neighbouring places in any order. Spark computes the ranges when this is called.
    """
    placed = cut_lineage(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dict(map(tuple, placed.groupBy("_range").agg(F.count("*")).collect()))
    starts, before = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    begin = F.get(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("_range")) if starts else F.lit(0).cast("bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("position", begin + inside - 1).drop("_range")


def hash_cuts(df: DataFrame, label: str, ident: str, percents: list[float], seed: int, digits: int = 3, counts_given: bool = False) -> DataFrame:
    """Per label, the seeded key of the last row at or below each percentage.

    With ``counts_given`` the list holds row counts instead; a label with fewer rows is
    cut after its last row.

    Counts per hash prefix find the prefix in which a cut falls; only the rows of
    that prefix are ranked. Columns: label, ``cut_0`` ... ``cut_{n-1}``; a cut that
    takes no row is empty, and a label without any cut row is absent.
    """
    keyed = df.select(label, seeded_key(seed, F.col(ident)).alias("_key")).withColumn(
        "_bucket", F.substring("_key", 1, digits)
    )
    counts = keyed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy(label))
    )
    place = (lambda p: F.least(F.col("_all"), F.lit(p))) if counts_given else (lambda p: F.floor(F.col("_all") * p / 100))
    targets = F.array(*[F.struct(F.lit(i).alias("i"), place(p).cast("bigint").alias("t")) for i, p in enumerate(percents)])
    needed = (
        placed.withColumn("_c", F.explode(targets))
        .filter((F.col("_c.t") > F.col("_upto") - F.col("_n")) & (F.col("_c.t") <= F.col("_upto")))
        .select(label, "_bucket", F.col("_c.i").alias("_i"), (F.col("_c.t") - F.col("_upto") + F.col("_n")).alias("_rn"))
    )
    wanted = needed.groupBy(label, "_bucket").agg(F.collect_list(F.struct("_i", "_rn")).alias("_wanted"))
    named = wanted.withColumnRenamed(label, "_of").withColumnRenamed("_bucket", "_at")
    # Null-safe on the label: rows without one form a stratum too.
    inside = F.col(label).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at"))
    ranked = keyed.join(named, inside).drop("_of", "_at").withColumn(
        "_pos", F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_key"))
    )
    hits = ranked.withColumn("_w", F.explode("_wanted")).filter(F.col("_w._rn") == F.col("_pos"))
    cuts = [
        F.coalesce(F.max(F.when(F.col("_w._i") == i, F.col("_key"))), F.lit("")).alias(f"cut_{i}")
        for i in range(len(percents))
    ]
    return hits.groupBy(label).agg(*cuts)
