"""Classifier reports: accuracy, confusion, per-label scores, token comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chat import bind


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    return df.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"), F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """Long confusion counts ``(truth, predicted, n)``: the only pass over the data."""
    n = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(n.alias("n"))


def confusion_matrix(counts: DataFrame, labels: list | None = None) -> DataFrame:
    """Square matrix with sorted labels, truth on the rows, zero where nothing fell.

    Rows and columns are the labels found on either side, and those of ``labels`` besides; a
    null label comes last, as the column ``null``. ``counts`` has a row per pair of labels.
    """
    both = counts.select(F.explode(F.array("truth", "predicted")).alias("x")).distinct()
    found = {r[0] for r in both.collect()} | set(labels or ())
    ordered = [*sorted(x for x in found if x is not None), *([None] if None in found else [])]
    same = lambda x: F.col("predicted").isNull() if x is None else F.col("predicted") == x
    cells = [F.sum(F.when(same(x), F.col("n")).otherwise(0)).alias("null" if x is None else str(x)) for x in ordered]
    filled = counts.groupBy(F.col("truth").alias("_truth")).agg(*cells)
    kind = counts.schema["truth"].dataType.simpleString()
    spine = counts.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ordered)], f"_place int, truth {kind}")
    rows = spine.join(filled, F.col("truth").eqNullSafe(F.col("_truth")), "left").orderBy("_place")
    return rows.select("truth", *[F.coalesce(F.col(f"`{name}`"), F.lit(0)).alias(name) for name in filled.columns[1:]])


def label_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; an empty denominator gives zero.

    Every count is booked for its true and for its predicted label in the same pass,
    so the data behind ``counts`` is read once.
    """
    zero = F.lit(0).cast("bigint")
    same = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(zero)
    booked = F.array(
        F.struct(F.col("truth").alias("label"), same.alias("tp"), F.col("n").alias("support"), zero.alias("claimed")),
        F.struct(F.col("predicted").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("claimed")),
    )
    sums = counts.select(F.inline(booked)).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        "label", ratio(F.col("tp"), F.col("claimed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("claimed") + F.col("support")).alias("f1"), "support", "tp",
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """Label rows plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    The label rows, one per class, are held next to their totals in one row, so that
    both come from the same computation.
    """
    names = ["precision", "recall", "f1"]
    scores = label_scores(counts)
    fields = [F.col("label").cast("string").alias("label"), *[F.col(n) for n in names], F.col("support")]
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    right = F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0))
    total = lambda label, value: F.struct(F.lit(label).alias("label"), *[value(n).alias(n) for n in names], F.sum("support").alias("support"))
    totals = F.array(total("accuracy", lambda n: right), total("macro avg", F.avg), total("weighted avg", weighted))
    rows = scores.agg(F.concat(F.collect_list(F.struct(*fields)), totals).alias("rows"))
    return rows.select(F.explode("rows").alias("r")).select("r.*").filter(F.col("support").isNotNull())


def weighted_f1(counts: DataFrame) -> DataFrame:
    return classification_report(counts).filter("label = 'weighted avg'").select(F.col("f1").alias("weighted_f1"), F.col("support"))


def position_counts(df: DataFrame, truth: str, predicted: str, skip: int) -> DataFrame:
    """Confusion counts over array positions; positions whose truth is ``skip`` are left out.

    Every task collapses its positions to one row per distinct pair before the shuffle.
    """
    # The outer form spares the plan an inferred filter that would compute the arrays again.
    pairs = df.select(F.explode_outer(F.arrays_zip(F.col(truth).alias("t"), F.col(predicted).alias("p"))).alias("z"))
    flat = pairs.select(F.col("z.t").alias("truth"), F.col("z.p").alias("predicted"))
    return confusion(flat.filter(F.col("truth") != skip), "truth", "predicted")


def token_match(left: Column, right: Column, show: int = 5) -> Column:
    """Compare two token arrays position by position up to the shorter length.

    ``struct<compared, matches, match_pct, mismatches>``; the comparison stays in the row.
    """
    def shared(sides: Column) -> Column:
        shorter = F.least(F.size(sides["l"]), F.size(sides["r"]))
        return F.zip_with(
            F.slice(sides["l"], 1, shorter), F.slice(sides["r"], 1, shorter), lambda x, y: F.struct(x.alias("left"), y.alias("right"))
        )

    def compare(z: Column) -> Column:
        same = F.size(F.filter(z, lambda p: p["left"] == p["right"]))
        placed = F.transform(z, lambda p, i: F.struct(i.alias("pos"), p["left"].alias("left"), p["right"].alias("right")))
        apart = F.filter(placed, lambda p: p["left"] != p["right"])
        pct = F.when(F.size(z) > 0, same / F.size(z) * 100).otherwise(0.0)
        return F.struct(
            F.size(z).alias("compared"), same.alias("matches"), pct.alias("match_pct"), F.slice(apart, 1, show).alias("mismatches")
        )

    return bind(F.struct(left.alias("l"), right.alias("r")), lambda s: bind(shared(s), compare))


def token_match_rows(left: DataFrame, right: DataFrame, position: str = "pos", token: str = "token") -> DataFrame:
    """The same for two token tables with one row per position: totals as one row."""
    a = left.select(position, F.col(token).alias("_l"))
    b = right.select(position, F.col(token).alias("_r"))
    joined = a.join(b, position)
    return joined.agg(
        F.count("*").alias("compared"), F.count_if(F.col("_l") == F.col("_r")).alias("matches"),
        F.coalesce(F.try_divide(F.count_if(F.col("_l") == F.col("_r")) * 100.0, F.count("*")), F.lit(0.0)).alias("match_pct"),
    )


def first_mismatches(left: DataFrame, right: DataFrame, n: int = 5, position: str = "pos", token: str = "token") -> DataFrame:
    a = left.select(position, F.col(token).alias("left"))
    b = right.select(position, F.col(token).alias("right"))
    return a.join(b, position).filter(F.col("left") != F.col("right")).orderBy(position).limit(n)
