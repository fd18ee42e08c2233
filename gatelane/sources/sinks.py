"""Sinks: results, analyses, routing tables, label maps, reports, audits, metrics."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from ..settings import CACHE_ENTRIES, CACHE_TTL, RouterConfig

SMALL = 100_000  # rows that an export may bring to the driver


def few_rows(df: DataFrame, limit: int = SMALL) -> list:
    """Rows of a configuration-sized table; refuses anything larger."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write this table with Spark instead")
    return rows


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: they are written as JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def side_by_side(*one_row_tables: DataFrame) -> DataFrame:
    """Put one-row tables next to each other, by a union and one aggregate instead of joins."""
    union = one_row_tables[0]
    for other in one_row_tables[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    return union.agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns])


def save_results(results: DataFrame, path: str) -> None:
    """Detailed results as CSV, one folder per model and approach."""
    _flat(results).write.mode("overwrite").partitionBy("model", "approach").option("header", True).csv(path)


def analyses(summary: DataFrame, accuracies: DataFrame, keys: list[str]) -> DataFrame:
    """Summary rows with their category accuracies as a map (bounded by the categories)."""
    maps = accuracies.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("category", "accuracy"))).alias("category_accuracy"))
    return summary.join(maps, keys, "left")


def _folder(df: DataFrame) -> DataFrame:
    return df.withColumn("dir", texts.result_dir(F.col("model"), F.col("approach") == "cot"))


def save_analyses(analysis: DataFrame, path: str) -> None:
    """``analysis`` rows as JSON, one folder per model and approach."""
    _folder(analysis).drop("model", "approach").write.mode("overwrite").partitionBy("dir").json(path)


def save_summaries(summary: DataFrame, path: str) -> None:
    """The same without the category map."""
    name = F.when(F.col("approach") == "cot", "Chain-of-Thought").otherwise("Direct")
    rows = _folder(summary).withColumn("approach", name)
    rows.drop("category_accuracy").write.mode("overwrite").partitionBy("dir").json(path)


def export_analyses(analysis: DataFrame, folder: str) -> None:
    """One ``analysis.json`` per model and approach, for tools that expect exactly these files."""
    for row in few_rows(_folder(analysis)):
        target = Path(folder) / row["dir"]
        target.mkdir(parents=True, exist_ok=True)
        body = {k: v for k, v in row.asDict(recursive=True).items() if k not in ("dir", "model", "approach")}
        (target / "analysis.json").write_text(json.dumps(body, indent=2))


def save_routing_table(ranked: DataFrame, path: str) -> None:
    ranked.write.mode("overwrite").parquet(path)


def config_body(ranked: DataFrame, default_model: str, config: RouterConfig | None = None, similarity: float = 0.8) -> dict:
    """Content of the router's configuration file from a ranked routing table."""
    config = config or RouterConfig()
    categories: dict[str, list] = {}
    for row in sorted(few_rows(ranked), key=lambda r: (r["category"], r["pos"])):
        categories.setdefault(row["category"], []).append({"model": row["model"], "score": float(row["score"])})
    return {
        "semantic_cache": {
            "enabled": True, "similarity_threshold": similarity, "max_entries": CACHE_ENTRIES, "ttl_seconds": CACHE_TTL,
        },
        "classifier": {
            "category_model": {"threshold": config.category_threshold}, "pii_model": {"threshold": config.pii_threshold},
            "load_aware": config.load_aware,
        },
        "categories": [{"name": name, "model_scores": scores} for name, scores in categories.items()],
        "default_model": default_model,
    }


def export_config(ranked: DataFrame, default_model: str, path: str, config: RouterConfig | None = None, similarity: float = 0.8) -> dict:
    """Router YAML on the driver; the gateway's loader reads it back."""
    body = config_body(ranked, default_model, config, similarity)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(body, sort_keys=False))
    return body


def save_config(ranked: DataFrame, default_model: str, path: str, config: RouterConfig | None = None, similarity: float = 0.8) -> None:
    """The same in a folder of any store that Spark writes to, as one file."""
    text = yaml.safe_dump(config_body(ranked, default_model, config, similarity), sort_keys=False)
    ranked.sparkSession.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


MAP_LABELS = 10_000  # labels in one map


def label_maps(index: DataFrame, label: str = "label", idx: str = "label_id", most: int = MAP_LABELS) -> DataFrame:
    """Both directions of a label index as maps with text keys: one row, or one for each ``most`` indices of a large vocabulary."""
    key = F.col(idx).cast("string")
    return index.groupBy(F.floor(F.col(idx) / most).alias("_part")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label), F.col(idx))))).alias("label_to_idx"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, F.col(label))))).alias("idx_to_label"),
    ).drop("_part")


def save_label_maps(index: DataFrame, path: str, label: str = "label", idx: str = "label_id", most: int = MAP_LABELS) -> None:
    """Map files; a vocabulary above ``most`` labels is spread over several lines and files, which are read back as one."""
    label_maps(index, label, idx, most).write.mode("overwrite").json(path)


def save_report(report: DataFrame, matrix: DataFrame, accuracy: DataFrame, path: str) -> None:
    """Accuracy, report and confusion counts as one nested JSON row; all parts are class-sized."""
    rows = report.agg(F.collect_list(F.struct(*report.columns)).alias("classification_report"))
    cells = matrix.agg(F.collect_list(F.struct(*matrix.columns)).alias("confusion"))
    side_by_side(accuracy, rows, cells).write.mode("overwrite").json(path)


def save_centroids(centroids: DataFrame, path: str) -> None:
    centroids.write.mode("overwrite").parquet(path)


def append_audit(questions: DataFrame, path: str, prompt: str = "prompt", answer: str = "answer", category: str | None = "category") -> None:
    """Append category, prompt and right answer of every question as text."""
    head = [F.lit("Category: "), F.col(category), F.lit("\n")] if category else []
    entry = F.concat(*head, F.lit("Prompt: "), F.col(prompt), F.lit("\nCorrect answer: "), F.col(answer), F.lit("\n"))
    questions.select(entry.alias("value")).write.mode("append").text(path)


def save_rewritten(routed: DataFrame, path: str, ident: str) -> None:
    """Rewritten bodies of routed requests."""
    kept = routed.filter(F.col("rewritten_body").isNotNull())
    kept.select(ident, "served_model", F.col("rewritten_body").alias("body")).write.mode("append").parquet(path)


def save_metrics(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").parquet(path)


def save_history(rows: DataFrame, path: str) -> None:
    """Per-iteration training figures."""
    rows.write.mode("overwrite").json(path)
