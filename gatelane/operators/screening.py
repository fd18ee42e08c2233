"""Turning scores into decisions: category, personal data and jailbreak screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import JAILBREAK_LABELS, NO_PII, PII_LABELS, RouterConfig
from .scorers import Scorer


def label_of(index: Column, labels: list[str]) -> Column:
    """Label of a class index; NULL if the index is unknown. Small constant vocabularies."""
    return F.when(index >= 0, F.get(F.array(*[F.lit(x) for x in labels]), index))


def with_label(df: DataFrame, labels: DataFrame, head: str, index: str, out: str = "label") -> DataFrame:
    """The same lookup as a join against the label table."""
    names = labels.filter(F.col("head") == head).select(F.col("idx").alias(index), F.col("label").alias(out))
    return df.join(names, index, "left")


def category_decision(scored: Column, labels: list[str], threshold: float) -> Column:
    """Category label; empty below the threshold, for unknown classes and on failure."""
    passed = scored["confidence"] >= threshold
    return F.coalesce(F.when(passed, label_of(scored["class"], labels)), F.lit(""))


def pii_decision(scored: Column, labels: list[str] | None, threshold: float) -> Column:
    """PII label, ``NO_PII`` when unsure; NULL when the scorer failed."""
    if labels is None:
        return F.lit(NO_PII)
    found = F.when(scored["confidence"] >= threshold, label_of(scored["class"], labels))
    return F.when(scored.isNotNull(), F.coalesce(found, F.lit(NO_PII)))


def guard_decision(scored: Column, labels: list[str], threshold: float) -> Column:
    """``struct<flag, type, confidence>``; NULL when the scorer failed or the class is unknown."""
    kind = label_of(scored["class"], labels)
    flag = (scored["confidence"] >= threshold) & (kind == "jailbreak")
    return F.when(kind.isNotNull(), F.struct(flag.alias("flag"), kind.alias("type"), scored["confidence"].alias("confidence")))


def detected_pii(contents: Column, scorer: Scorer, config: RouterConfig) -> Column:
    """Distinct PII types over a request's contents, first seen first; empty contents are skipped."""
    texts = F.filter(contents, lambda c: c != "")
    # Score first, decide second: the decision reads the score more than once.
    found = F.transform(F.transform(texts, scorer.score), lambda s: pii_decision(s, PII_LABELS, config.pii_threshold))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull() & (t != NO_PII)))


def first_jailbreak(contents: Column, scorer: Scorer, config: RouterConfig) -> Column:
    """First flagged content as ``struct<index, type, confidence>``, NULL if none is flagged."""
    if not config.guard_enabled:
        return F.lit(None).cast("struct<index:int,type:string,confidence:double>")
    scores = F.transform(contents, lambda c: F.when(c != "", scorer.score(c)))
    judged = F.transform(
        scores,
        lambda s, i: F.struct(i.alias("index"), guard_decision(s, JAILBREAK_LABELS, config.guard_threshold).alias("d")),
    )
    flagged = F.filter(judged, lambda j: F.coalesce(j["d"]["flag"], F.lit(False)))
    first = F.transform(
        flagged,
        lambda j: F.struct(j["index"].alias("index"), j["d"]["type"].alias("type"), j["d"]["confidence"].alias("confidence")),
    )
    return F.get(first, F.lit(0))


def screen_rows(scored: DataFrame, request: str, position: str, config: RouterConfig) -> DataFrame:
    """The same screening for contents stored one per row, already scored.

    Expects ``content``, ``pii`` and ``guard`` score structs. Aggregates are partial
    per task, so a request with very many contents is combined before the shuffle.
    """
    pii = pii_decision(F.col("pii"), PII_LABELS, config.pii_threshold)
    guard = guard_decision(F.col("guard"), JAILBREAK_LABELS, config.guard_threshold)
    filled = F.col("content") != ""
    rows = scored.select(
        request, F.col(position).alias("_pos"), F.when(filled, pii).alias("_pii"), F.when(filled, guard).alias("_guard")
    )
    # First position per label of the vocabulary, and the first flagged content: one pass.
    labels = [label for label in PII_LABELS if label != NO_PII]
    seen = [F.min(F.when(F.col("_pii") == label, F.col("_pos"))).alias(f"_first_{i}") for i, label in enumerate(labels)]
    flagged = F.when(F.col("_guard.flag"), F.col("_pos"))
    first = F.min_by(F.struct(F.col("_pos").alias("index"), "_guard.type", "_guard.confidence"), flagged)
    found = rows.groupBy(request).agg(*seen, first.alias("jailbreak"))
    firsts = F.array(*[F.struct(F.col(f"_first_{i}").alias("pos"), F.lit(label).alias("label")) for i, label in enumerate(labels)])
    ordered = F.array_sort(F.filter(firsts, lambda s: s["pos"].isNotNull()))
    return found.select(request, F.transform(ordered, lambda s: s["label"]).alias("detected"), "jailbreak")


def screen_requests(requests: DataFrame, contents: str, pii: Scorer, guard: Scorer, config: RouterConfig) -> DataFrame:
    """Add ``detected`` and ``jailbreak`` to requests that carry their contents as an array."""
    return requests.withColumn("detected", detected_pii(F.col(contents), pii, config)).withColumn(
        "jailbreak", first_jailbreak(F.col(contents), guard, config)
    )
