"""Benchmark evaluation on benchmark items and document replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import evaluation as ev
from ..plans.evaluation import evaluate
from ..session import spread
from .common import sql_list, sql_text, table

QUERIES, SQL = {}, {}
EVAL_MODELS = ["phi4", "gemma3:27b", "org/mistral-small3.1", "auto"]
SOURCES = [f"src{i}" for i in range(20)]  # columns of the check SQL; the query takes them from the data


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read as one model's reply to one benchmark item."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), "doc_id")
    items = table(spark, sf_dir, "benchmark").select("item_id")
    count = items.count()
    letters = F.array(*[F.lit(c) for c in texts.LETTERS])
    rows = docs.select(
        "doc_id", F.col("text").alias("model_response"), F.col("source").alias("category"),
        (F.col("doc_id") % count).alias("question_id"),
        F.element_at(F.array(*[F.lit(m) for m in EVAL_MODELS]), (F.col("doc_id") % 4 + 1).cast("int")).alias("model"),
        F.when(F.floor(F.col("doc_id") / 4) % 2 == 0, "cot").otherwise("direct").alias("approach"),
        (F.col("n_chars") / 1000).alias("response_time"), (F.col("doc_id") % 17 != 0).alias("success"),
    )
    answered = items.select(F.col("item_id").alias("question_id"), F.get(letters, (F.col("item_id") % 10).cast("int")).alias("correct_answer"))
    return rows.join(answered, "question_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = ev.grade(replies(spark, sf_dir), "model_response", "correct_answer", "success").drop("model_response")
    return graded.withColumn("display_name", texts.display_name(F.col("model"), F.col("approach")))


def evaluation_job_of(spark: SparkSession, sf_dir: str):
    """The evaluation plan on the same replies: questions with their answers, and a table of replies."""
    given = replies(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"), F.get(F.array(*[F.lit(c) for c in texts.LETTERS]), (F.col("item_id") % 10).cast("int")).alias("answer")
    )
    return evaluate(items, given.withColumnRenamed("model_response", "response").drop("correct_answer"))


def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.category_accuracy(results(spark, sf_dir), "display_name")



def sql_answer(text: str, pattern: str, letters: str) -> str:
    return (
        f"coalesce(nullif(upper(regexp_extract({text}, {sql_text(pattern)}, 1)), ''), "
        f"nullif(upper(regexp_extract({text}, '(?is)^.*([{letters}])', 1)), ''))"
    )


SQL_RESULTS = f"""
r AS (SELECT d.doc_id, source AS category, {sql_list(EVAL_MODELS)}[(doc_id % 4 + 1)::INT] AS model,
  CASE WHEN (doc_id // 4) % 2 = 0 THEN 'cot' ELSE 'direct' END AS approach, n_chars / 1000 AS response_time, doc_id % 17 <> 0 AS success,
  {sql_list(texts.LETTERS)}[(b.item_id % 10 + 1)::INT] AS correct_answer, {sql_answer('d.text', texts.ANSWER_AJ, 'A-J')} AS found
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
results AS (SELECT *, model || ':' || approach AS display_name, CASE WHEN success THEN found END AS predicted_answer,
  coalesce(success AND found = correct_answer, false) AS is_correct FROM r),
acc AS (SELECT display_name, category, avg(is_correct::INT) AS accuracy FROM results WHERE success GROUP BY ALL)"""


@query
def graded_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted letter and correctness of every reply."""
    return results(spark, sf_dir).select("doc_id", "display_name", "correct_answer", "predicted_answer", "is_correct")


SQL["graded_replies"] = f"WITH {SQL_RESULTS} SELECT doc_id, display_name, correct_answer, predicted_answer, is_correct FROM results"


@query
def extract_answer_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-choice extraction, corrected and historical pattern."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    stated = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " The answer is: b, not d").otherwise(""))
    rows = docs.select("doc_id", stated.alias("t"))
    return rows.select("doc_id", texts.answer_letter_four(F.col("t")).alias("fixed"), texts.answer_letter_four(F.col("t"), True).alias("faithful"))


SQL["extract_answer_four"] = f"""WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' The answer is: b, not d' ELSE '' END AS t FROM documents)
SELECT doc_id, {sql_answer('t', texts.ANSWER_AD, 'A-D')} AS fixed, {sql_answer('t', texts.ANSWER_AD_LITERAL, 'A-D')} AS faithful FROM t"""


@query
def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered prompts from benchmark items: paragraphs as options, one placeholder among them."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    options = F.concat(F.array(F.lit("first"), F.lit("N/A")), F.split("text", r"\.\n"))
    labels = F.array(*[F.lit(c) for c in "ABCD"])
    rows = items.select("item_id", "text", options.alias("o"))
    lines = texts.lettered_options(F.col("o"))
    return rows.select(
        "item_id", texts.question_prompt(F.col("text"), lines, True).alias("cot"),
        texts.question_prompt(F.col("text"), texts.labelled_choices(labels, F.col("o"))).alias("four_choice"),
    )


SQL["question_prompts"] = f"""
WITH o AS (SELECT item_id, text, list_concat(['first', 'N/A'], regexp_split_to_array(text, '\\.\\n')) AS o FROM benchmark),
l AS (SELECT item_id, text, array_to_string(list_transform(list_filter(range(1, len(o) + 1), lambda i: lower(o[i]) <> 'n/a'),
    lambda i: chr((64 + i)::INT) || ') ' || o[i] || chr(10)), '') AS opts,
  array_to_string(list_transform(range(1, least(len(o), 4) + 1), lambda i: chr((64 + i)::INT) || ') ' || o[i] || chr(10)), '') AS four FROM o)
SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || 'Options:' || chr(10) || opts || chr(10) || chr(10) || {sql_text(texts.SUFFIX_COT)} AS cot,
  'Question: ' || text || chr(10) || chr(10) || 'Options:' || chr(10) || four || chr(10) || chr(10) || {sql_text(texts.SUFFIX_DIRECT)} AS four_choice FROM l"""


@query
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result directory and display names of every evaluated model, written and read back."""
    rows = replies(spark, sf_dir).groupBy("model", "approach").agg(F.count("*").alias("n"))
    named = rows.withColumn("dir", texts.result_dir(F.col("model"), F.col("approach") == "cot"))
    display = texts.display_name(texts.dir_model(F.col("dir")), texts.dir_approach(F.col("dir")))
    return named.select(
        "dir", display.alias("display"), texts.short_display(display).alias("short"), texts.base_model(display).alias("base"),
        texts.base_model(display, True).alias("base_faithful"), "n",
    )


SQL["model_names"] = f"""WITH {SQL_RESULTS}, m AS (SELECT model, approach, count(*) AS n FROM r GROUP BY ALL)
SELECT replace(model, '/', '_') || '_' || approach AS dir, model || ':' || approach AS display,
  CASE WHEN approach = 'cot' THEN model || ':cot' ELSE model END AS short, model AS base, split_part(model, ':', 1) AS base_faithful, n FROM m"""


@query
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, time and totals per model and approach."""
    s = ev.summarize(results(spark, sf_dir), "display_name")
    return s.withColumn("overall_accuracy", F.round("overall_accuracy", 6)).withColumn("avg_response_time", F.round("avg_response_time", 6))


SQL["eval_summary"] = f"""WITH {SQL_RESULTS}
SELECT display_name, round(coalesce(avg(is_correct::INT) FILTER (success), 0.0), 6) AS overall_accuracy,
  round(coalesce(avg(response_time) FILTER (success), 0.0), 6) AS avg_response_time, count(*) AS total_questions,
  count(*) FILTER (success) AS successful_queries, count(*) FILTER (NOT success) AS failed_queries FROM results GROUP BY display_name"""


@query
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracies(spark, sf_dir).withColumn("accuracy", F.round("accuracy", 6))


SQL["category_accuracy"] = f"WITH {SQL_RESULTS} SELECT display_name, category, round(accuracy, 6) AS accuracy FROM acc"


@query
def overall_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category accuracies with the macro average added as its own category."""
    return ev.with_overall(accuracies(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


SQL["overall_row"] = f"""WITH {SQL_RESULTS}
SELECT display_name, category, round(accuracy, 6) AS accuracy FROM acc
UNION ALL SELECT display_name, 'Overall', round(avg(accuracy), 6) FROM acc GROUP BY display_name"""


@query
def evaluation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation plan: accuracies per model, approach and category, with the summary beside them."""
    done = evaluation_job_of(spark, sf_dir)
    summary = done.summary.select("model", "approach", "total_questions", F.round("overall_accuracy", 6).alias("overall_accuracy"))
    return done.accuracies.join(summary, ["model", "approach"]).select(
        "model", "approach", "display_name", "category", F.round("accuracy", 6).alias("accuracy"), "total_questions", "overall_accuracy"
    )


SQL["evaluation_job"] = f"""WITH {SQL_RESULTS},
per AS (SELECT model, approach, category, avg(is_correct::INT) AS accuracy FROM results WHERE success GROUP BY ALL),
s AS (SELECT model, approach, count(*) AS total_questions, coalesce(avg(is_correct::INT) FILTER (success), 0) AS overall FROM results GROUP BY ALL)
SELECT model, approach, model || ':' || approach AS display_name, category, round(accuracy, 6) AS accuracy, total_questions, round(overall, 6) AS overall_accuracy
FROM per JOIN s USING (model, approach)"""


@query
def accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model by category matrix."""
    wide = ev.accuracy_matrix(accuracies(spark, sf_dir))
    return wide.select("display_name", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


SQL["accuracy_matrix"] = f"""WITH {SQL_RESULTS}
SELECT display_name, {", ".join(f"round(coalesce(max(accuracy) FILTER (category = '{c}'), 0), 6) AS {c}" for c in SOURCES)},
  round(avg(accuracy), 6) AS "Overall" FROM acc GROUP BY display_name"""


@query
def ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing table built from the accuracies."""
    return ev.ranked_scores(accuracies(spark, sf_dir)).withColumn("score", F.round("score", 6))


SQL["ranked_scores"] = f"""WITH {SQL_RESULTS}
SELECT category, (row_number() OVER (PARTITION BY category ORDER BY accuracy DESC, display_name) - 1)::INT AS pos,
  regexp_replace(display_name, ':(cot|direct)$', '') AS model, round(accuracy, 6) AS score FROM acc WHERE split_part(display_name, ':', 1) <> 'auto'"""


@query
def default_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model with the best macro average."""
    return ev.default_model(accuracies(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


SQL["default_model"] = f"""WITH {SQL_RESULTS}, m AS (SELECT display_name, avg(accuracy) AS a FROM acc WHERE split_part(display_name, ':', 1) <> 'auto' GROUP BY 1)
SELECT regexp_replace(display_name, ':(cot|direct)$', '') AS default_model, round(a, 6) AS accuracy FROM m ORDER BY a DESC, display_name LIMIT 1"""


@query
def ranked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of each model ranked by accuracy."""
    from pyspark.sql import Window

    order = Window.partitionBy("display_name").orderBy(F.desc("accuracy"), "category")
    return accuracies(spark, sf_dir).select("display_name", "category", F.row_number().over(order).alias("rank"), F.round("accuracy", 6).alias("accuracy"))


SQL["ranked_categories"] = f"""WITH {SQL_RESULTS}
SELECT display_name, category, row_number() OVER (PARTITION BY display_name ORDER BY accuracy DESC, category)::INT AS rank,
  round(accuracy, 6) AS accuracy FROM acc"""


@query
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ev.distinct_categories(ev.filter_categories(docs, ["src1", "src2", "src7", "absent"], "source"), "source")


SQL["distinct_categories"] = "SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2', 'src7', 'absent')"


@query
def sample_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five seeded questions per category."""
    return ev.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


SQL["sample_per_category"] = """SELECT doc_id, source FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id) || ':' || doc_id) <= 5"""


@query
def sample_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty seeded questions."""
    return ev.sample_overall(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50)


SQL["sample_overall"] = "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id) || ':' || doc_id LIMIT 50"
