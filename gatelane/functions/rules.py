"""Rule-based scoring of single texts: pattern families for personal data and guard phrases.

These are the dependency-free scorers; any model can take their place through
``gatelane.operators.scorers``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import EMAIL, PHONE, SSN

# Checked in this order; the first family that occurs gives the text its type.
PII_PATTERNS = {
    "CREDIT_CARD": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "US_SSN": SSN,
    "EMAIL_ADDRESS": EMAIL,
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "PHONE_NUMBER": PHONE,
}
GUARD_PATTERN = (
    r"(?i)\b(ignore|disregard|forget)\b.{0,40}\b(previous|prior|above|all|your)\b.{0,40}"
    r"\b(instructions?|rules?|guidelines?|prompts?)\b"
    r"|\bpretend\b.{0,40}\b(unrestricted|no (rules|restrictions|limits)|evil)\b"
    r"|\b(developer|dan|jailbreak) mode\b|\bdo anything now\b"
    r"|\b(without|bypass|override)\b.{0,30}\b(safety|ethical|content)\b.{0,20}\b(guidelines?|filters?|restrictions?|protocols?)\b"
)


def pii_types(text: Column) -> Column:
    """Every pattern family found in the text, in pattern order."""
    hits = [F.when(text.rlike(p), F.lit(name)) for name, p in PII_PATTERNS.items()]
    return F.array_compact(F.array(*hits))


def pii_class(text: Column, idx: dict[str, int]) -> Column:
    """``struct<class, confidence>`` of the first family found; full confidence either way."""
    label = F.coalesce(*[F.when(text.rlike(p), F.lit(idx[name])) for name, p in PII_PATTERNS.items()], F.lit(idx["NO_PII"]))
    return F.struct(label.cast("int").alias("class"), F.lit(1.0).alias("confidence"))


def guard_class(text: Column) -> Column:
    """``struct<class, confidence>`` with class 1 for a guard phrase."""
    return F.struct(text.rlike(GUARD_PATTERN).cast("int").alias("class"), F.lit(1.0).alias("confidence"))
