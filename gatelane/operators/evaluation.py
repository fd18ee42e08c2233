"""Benchmark evaluation: sampling, grading, accuracies and model rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import answer_letter, answer_letter_four, base_model, is_correct, seeded_key

AUTO = "auto"
OVERALL = "Overall"
FEW = 1000  # up to here Spark limits the groups of a ranking before it shuffles them


def distinct_categories(questions: DataFrame, category: str = "category") -> DataFrame:
    return questions.select(category).distinct().orderBy(category)


def filter_categories(questions: DataFrame, wanted: list[str] | None, category: str = "category") -> DataFrame:
    """Keep the wanted categories; an empty result is an error that names the valid ones."""
    if not wanted:
        return questions
    kept = questions.filter(F.col(category).isin(*wanted))
    if kept.isEmpty():
        valid = ", ".join(r[0] for r in distinct_categories(questions, category).collect())
        raise ValueError(f"none of the wanted categories occurs; the table has: {valid}")
    return kept


def sample_per_group(df: DataFrame, group: str, ident: str, n: int, seed: int = 42, digits: int = 3) -> DataFrame:
    """``n`` seeded rows per group, exactly; smaller groups stay whole.

    Rows are ordered by the seeded key of their identifier (a null one counts as empty), then
    by a hash of the whole row, so repeated identifiers have a fixed order too. Counts per key prefix
    tell which prefixes lie wholly inside the sample; only the prefix that holds the
    n-th row is ranked, so a hot group is spread over its prefixes. For up to ``FEW`` rows a
    group every task keeps that many of each group itself, and only those meet: one pass.
    """
    key = seeded_key(seed, F.coalesce(F.col(ident).cast("string"), F.lit("")))
    if n <= FEW:
        ranked = df.withColumns({"_key": key, "_all": F.xxhash64(*df.columns)})
        rank = F.row_number().over(Window.partitionBy(group).orderBy("_key", "_all"))
        return ranked.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(df.columns)
    keyed = df.withColumns({"_key": key, "_bucket": F.substring(key, 1, digits), "_all": F.xxhash64(*df.columns)})
    counts = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reach = counts.withColumn("_upto", upto).filter(F.col("_upto") - F.col("_n") < n).select(
        F.col(group).alias("_of"), F.col("_bucket").alias("_at"), "_upto", (F.lit(n) - F.col("_upto") + F.col("_n")).alias("_left")
    )
    near = keyed.join(reach, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    inside = near.filter(F.col("_upto") <= n).select(df.columns)
    order = Window.partitionBy(group, "_bucket").orderBy("_key", "_all")
    edge = near.filter(F.col("_upto") > n).withColumn("_rank", F.row_number().over(order)).filter("_rank <= _left")
    return inside.unionByName(edge.select(df.columns))


def sample_overall(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` seeded rows of the whole table, by the same rule."""
    return sample_per_group(df.withColumn("_one", F.lit("")), "_one", ident, n, seed).drop("_one")


def grade(replies: DataFrame, reply: str, answer: str, success: str, letters: int = 10, faithful: bool = False) -> DataFrame:
    """Add ``predicted_answer`` and ``is_correct``; a failed call has no prediction."""
    extracted = answer_letter(F.col(reply)) if letters == 10 else answer_letter_four(F.col(reply), faithful)
    graded = replies.withColumn("predicted_answer", F.when(F.col(success), extracted))
    return graded.withColumn("is_correct", is_correct(F.col("predicted_answer"), F.col(answer)))


def _accuracy() -> Column:
    return F.avg(F.when(F.col("success"), F.col("is_correct").cast("double")))


def summarize(results: DataFrame, *keys: str) -> DataFrame:
    """Accuracy and time over successful rows, totals over all rows; zero without any success."""
    return results.groupBy(*keys).agg(
        F.coalesce(_accuracy(), F.lit(0.0)).alias("overall_accuracy"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("response_time"))), F.lit(0.0)).alias("avg_response_time"),
        F.count("*").alias("total_questions"),
        F.count_if("success").alias("successful_queries"),
        F.count_if(~F.col("success")).alias("failed_queries"),
    )


def category_accuracy(results: DataFrame, *keys: str) -> DataFrame:
    """Accuracy per category over successful rows."""
    return results.filter("success").groupBy(*keys, "category").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"))


def macro_average(accuracies: DataFrame, model: str = "display_name") -> DataFrame:
    """Unweighted mean over categories."""
    return accuracies.groupBy(model).agg(F.avg("accuracy").alias("accuracy"))


def with_overall(accuracies: DataFrame, model: str = "display_name") -> DataFrame:
    """Add one ``Overall`` row per model.

    A model's rows, one per category, are gathered together with their mean, so the
    accuracies are computed once.
    """
    own = F.collect_list(F.struct("category", "accuracy"))
    total = F.array(F.struct(F.lit(OVERALL).alias("category"), F.avg("accuracy").alias("accuracy")))
    gathered = accuracies.groupBy(model).agg(F.concat(own, total).alias("rows"))
    return gathered.select(model, F.explode("rows").alias("r")).select(model, "r.category", "r.accuracy")


def accuracy_matrix(accuracies: DataFrame, categories: list[str] | None = None, model: str = "display_name") -> DataFrame:
    """Model by category matrix: sorted rows and columns, ``Overall`` last, missing cells zero.

    Columns are the categories found in the data, and those of ``categories`` besides. A
    null category has the column ``null``.
    """
    named = accuracies.withColumn("category", F.coalesce("category", F.lit("null")))
    found = {r[0] for r in named.select("category").distinct().collect()}  # one row per category
    columns = [*sorted((found | set(categories or ())) - {OVERALL}), OVERALL]
    wide = with_overall(named, model).groupBy(model).pivot("category", columns).agg(F.first("accuracy"))
    return wide.na.fill(0.0, columns).orderBy(model)


def without_auto(accuracies: DataFrame, model: str = "display_name") -> DataFrame:
    return accuracies.filter(base_model(F.col(model), faithful=True) != AUTO)


def ranked_scores(accuracies: DataFrame, model: str = "display_name", faithful: bool = False) -> DataFrame:
    """Routing table from accuracies: models per category, best first, automatic choice left out.

    Equal accuracies are ordered by name. ``faithful`` cuts model names at the first colon.
    """
    order = Window.partitionBy("category").orderBy(F.desc("accuracy"), model)
    ranked = without_auto(accuracies, model).withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    return ranked.select("category", "pos", base_model(F.col(model), faithful).alias("model"), F.col("accuracy").alias("score"))


def default_model(accuracies: DataFrame, model: str = "display_name", faithful: bool = False) -> DataFrame:
    """The model with the highest macro average, as one row."""
    best = macro_average(without_auto(accuracies, model), model).orderBy(F.desc("accuracy"), model).limit(1)
    return best.select(base_model(F.col(model), faithful).alias("default_model"), "accuracy")
