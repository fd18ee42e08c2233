"""From benchmark questions and model replies to summaries, rankings and a routing table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import evaluation as ev
from ..session import cut_lineage
from ..sources import readers, sinks


def prompts(questions: DataFrame, use_cot: bool = False, four_choice: bool = False) -> DataFrame:
    """Add ``prompt``; four-choice questions carry their own labels."""
    lines = (
        texts.labelled_choices(F.col("choices.label"), F.col("choices.text"))
        if four_choice else texts.lettered_options(F.col("options"))
    )
    return questions.withColumn("prompt", texts.question_prompt(F.col("question"), lines, use_cot))


@dataclass
class Evaluation:
    results: DataFrame
    summary: DataFrame
    accuracies: DataFrame


def evaluate(
    questions: DataFrame, responses: DataFrame, ident: str = "question_id", answer: str = "answer",
    categories: list[str] | None = None, per_category: int | None = None, seed: int = 42, letters: int = 10,
) -> Evaluation:
    """Grade a table of responses ``(model, approach, question id, response, response_time, success)``.

    Calling the models is somebody else's job; their replies arrive as a table.
    """
    chosen = ev.filter_categories(questions, categories) if "category" in questions.columns else questions
    if per_category:
        chosen = (
            ev.sample_per_group(chosen, "category", ident, per_category, seed)
            if "category" in chosen.columns else ev.sample_overall(chosen, ident, per_category, seed)
        )
    columns = [ident, F.col(answer).alias("correct_answer"), *[c for c in ("category",) if c in chosen.columns]]
    joined = responses.join(chosen.select(*columns), ident)
    graded = ev.grade(joined, "response", "correct_answer", "success", letters)
    named = graded.withColumn("display_name", texts.display_name(F.col("model"), F.col("approach")))
    # Graded once and written: summary, accuracies and the detailed sink all read it.
    results = cut_lineage(named, "graded")
    by_category = results if "category" in results.columns else results.withColumn("category", F.lit("all"))
    return Evaluation(
        results,
        ev.summarize(results, "model", "approach"),
        ev.category_accuracy(by_category, "model", "approach", "display_name"),
    )


def save(evaluation: Evaluation, path: str) -> None:
    """Detailed results, analyses and summaries below ``path``."""
    sinks.save_results(evaluation.results.drop("display_name"), f"{path}/results")
    analysis = sinks.analyses(evaluation.summary, evaluation.accuracies, ["model", "approach"])
    sinks.save_analyses(analysis, f"{path}/analysis")
    sinks.save_summaries(evaluation.summary, f"{path}/summary")


def build_routing_table(spark, results_path: str, pattern: str = "analysis.json", faithful: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ranked models per category and the default model, from stored analyses."""
    accuracies = readers.read_evaluations(spark, results_path, pattern, faithful)
    return ev.ranked_scores(accuracies, faithful=faithful), ev.default_model(accuracies, faithful=faithful)


def accuracy_matrix(spark, results_path: str, categories: list[str] | None = None, pattern: str = "analysis.json") -> DataFrame:
    """Model by category matrix with short display names, from stored analyses."""
    accuracies = readers.read_evaluations(spark, results_path, pattern)
    wide = ev.accuracy_matrix(accuracies, categories)
    return wide.withColumn("display_name", texts.short_display(F.col("display_name")))
