"""Router configuration: dataclasses, YAML/JSON loading, and dimension tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession

from .session import dimension

# --- Fixed values -----------------------------------------------------------
# Label vocabularies, list position = class index.
CATEGORY_LABELS = [
    "economics", "health", "computer science", "philosophy", "physics", "business", "engineering",
    "biology", "other", "math", "psychology", "chemistry", "law", "history",
]
PII_LABELS = [
    "AGE", "CREDIT_CARD", "DATE_TIME", "DOMAIN_NAME", "EMAIL_ADDRESS", "GPE", "IBAN_CODE", "IP_ADDRESS",
    "NO_PII", "NRP", "ORGANIZATION", "PERSON", "PHONE_NUMBER", "STREET_ADDRESS", "US_DRIVER_LICENSE",
    "US_SSN", "ZIP_CODE",
]
JAILBREAK_LABELS = ["benign", "jailbreak"]
LABELS = {"category": CATEGORY_LABELS, "pii": PII_LABELS, "jailbreak": JAILBREAK_LABELS}

# Routing table: models in listed order with their quality score.
CATEGORY_SCORES = {
    "business": [("phi4", 0.8), ("gemma3:27b", 0.4), ("mistral-small3.1", 0.2)],
    "law": [("gemma3:27b", 0.8), ("phi4", 0.6), ("mistral-small3.1", 0.4)],
    "psychology": [("mistral-small3.1", 0.6), ("gemma3:27b", 0.4), ("phi4", 0.4)],
    "biology": [("mistral-small3.1", 0.8), ("gemma3:27b", 0.6), ("phi4", 0.2)],
    "chemistry": [("mistral-small3.1", 0.8), ("gemma3:27b", 0.6), ("phi4", 0.6)],
    "history": [("mistral-small3.1", 0.8), ("phi4", 0.6), ("gemma3:27b", 0.4)],
    "other": [("gemma3:27b", 0.8), ("phi4", 0.6), ("mistral-small3.1", 0.6)],
    "health": [("gemma3:27b", 0.8), ("phi4", 0.8), ("mistral-small3.1", 0.6)],
    "economics": [("gemma3:27b", 0.8), ("mistral-small3.1", 0.8), ("phi4", 0.0)],
    "math": [("phi4", 1.0), ("mistral-small3.1", 0.8), ("gemma3:27b", 0.6)],
    "physics": [("gemma3:27b", 0.4), ("phi4", 0.4), ("mistral-small3.1", 0.4)],
    "computer science": [("gemma3:27b", 0.6), ("mistral-small3.1", 0.6), ("phi4", 0.0)],
    "philosophy": [("phi4", 0.6), ("gemma3:27b", 0.2), ("mistral-small3.1", 0.2)],
    "engineering": [("gemma3:27b", 0.6), ("mistral-small3.1", 0.6), ("phi4", 0.2)],
}
MODEL_SIZES = {"phi4": 14e9, "gemma3:27b": 27e9, "mistral-small3.1": 22e9}
ALLOWED_PII = ("EMAIL_ADDRESS", "PERSON", "GPE", "PHONE_NUMBER")
DEFAULT_MODEL = "mistral-small3.1"
GPU_FLOPS, GPU_HBM = 312e12, 2e12
MODEL_BATCH, MODEL_CONTEXT = 512.0, 16384.0
# Used for models without an entry.
UNKNOWN_PARAMS, UNKNOWN_BATCH, UNKNOWN_CONTEXT = 7e9, 512.0, 256.0
CATEGORY_THRESHOLD, PII_THRESHOLD, GUARD_THRESHOLD = 0.6, 0.7, 0.7
CACHE_THRESHOLD, CACHE_ENTRIES, CACHE_TTL = 0.8, 1000, 3600
AUTO_MODEL = "auto"
NO_PII = "NO_PII"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class CacheOptions:
    threshold: float = CACHE_THRESHOLD
    max_entries: int = CACHE_ENTRIES
    ttl_seconds: int = CACHE_TTL
    enabled: bool = True


@dataclass(frozen=True)
class ModelParams:
    param_count: float = 0.0
    batch_size: float = 0.0
    context_size: float = 0.0
    allow_by_default: bool = False
    allowed_pii: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    name: str
    scores: tuple[tuple[str, float], ...] = ()
    description: str = ""


@dataclass(frozen=True)
class RouterConfig:
    categories: tuple[Category, ...] = ()
    models: dict[str, ModelParams] = field(default_factory=dict)
    default_model: str = ""
    category_threshold: float = CATEGORY_THRESHOLD
    pii_threshold: float = PII_THRESHOLD
    guard_threshold: float = GUARD_THRESHOLD
    guard_enabled: bool = True
    load_aware: bool = False
    flops: float = GPU_FLOPS
    hbm: float = GPU_HBM
    cache: CacheOptions = CacheOptions()

    def __post_init__(self):
        if self.flops <= 0 or self.hbm <= 0:
            raise ValueError("gpu flops and hbm must be positive")

    def with_model(self, name: str, **changes) -> "RouterConfig":
        """A copy in which one model's parameters differ."""
        changed = replace(self.models.get(name, ModelParams()), **changes)
        return replace(self, models={**self.models, name: changed})


def default_config() -> RouterConfig:
    return RouterConfig(
        categories=tuple(Category(name, tuple(scores)) for name, scores in CATEGORY_SCORES.items()),
        models={
            name: ModelParams(size, MODEL_BATCH, MODEL_CONTEXT, False, ALLOWED_PII)
            for name, size in MODEL_SIZES.items()
        },
        default_model=DEFAULT_MODEL,
    )


def load_config(path: str, spark: SparkSession | None = None) -> RouterConfig:
    """Read a router YAML file (a few kilobytes, read once on the driver).

    With ``spark`` the path is a file, or a folder with one file, in any store that Spark reads.
    """
    if spark is None:
        text = Path(path).read_text()
    else:
        files = spark.read.text(path, wholetext=True).take(2)
        if len(files) > 1:
            raise ValueError(f"{path} holds several files")
        text = files[0]["value"] if files else ""
    raw = yaml.safe_load(text) or {}
    cache, guard = raw.get("semantic_cache") or {}, raw.get("prompt_guard") or {}
    gpu, heads = raw.get("gpu_config") or {}, raw.get("classifier") or {}
    base_threshold = (raw.get("bert_model") or {}).get("threshold", 0.0)
    models = {}
    for name, spec in (raw.get("model_config") or {}).items():
        policy = spec.get("pii_policy") or {}
        models[str(name)] = ModelParams(
            float(spec.get("param_count") or 0),
            float(spec.get("batch_size") or 0),
            float(spec.get("context_size") or 0),
            bool(policy.get("allow_by_default", False)),
            tuple(policy.get("pii_types_allowed") or ()),
        )
    categories = tuple(
        Category(
            item["name"],
            tuple((s["model"], float(s["score"])) for s in item.get("model_scores") or ()),
            item.get("description") or item["name"],
        )
        for item in raw.get("categories") or ()
    )
    return RouterConfig(
        categories=categories,
        models=models,
        default_model=raw.get("default_model", ""),
        category_threshold=float((heads.get("category_model") or {}).get("threshold", CATEGORY_THRESHOLD)),
        pii_threshold=float((heads.get("pii_model") or {}).get("threshold", PII_THRESHOLD)),
        guard_threshold=float(guard.get("threshold", GUARD_THRESHOLD)),
        guard_enabled=bool(guard.get("enabled", False)),
        load_aware=bool(heads.get("load_aware", False)),
        flops=float(gpu.get("flops", GPU_FLOPS)),
        hbm=float(gpu.get("hbm", GPU_HBM)),
        cache=CacheOptions(
            float(cache["similarity_threshold"]) if cache.get("similarity_threshold") is not None else float(base_threshold),
            int(cache.get("max_entries", 0)),
            int(cache.get("ttl_seconds", 0)),
            bool(cache.get("enabled", False)),
        ),
    )


def scores_table(spark: SparkSession, config: RouterConfig) -> DataFrame:
    """Long routing table ``(category_idx, category, pos, model, score)``; ``pos`` keeps listed order."""
    rows = [
        (ci, cat.name, pos, model, float(score))
        for ci, cat in enumerate(config.categories)
        for pos, (model, score) in enumerate(cat.scores)
    ]
    cols = list(zip(*rows)) or [[]] * 5
    return dimension(spark, pa.table({
        "category_idx": pa.array(cols[0], pa.int32()),
        "category": pa.array(cols[1], pa.string()),
        "pos": pa.array(cols[2], pa.int32()),
        "model": pa.array(cols[3], pa.string()),
        "score": pa.array(cols[4], pa.float64()),
    }))


def models_table(spark: SparkSession, config: RouterConfig) -> DataFrame:
    """Model parameters and privacy policy, one row per configured model."""
    items = list(config.models.items())
    return dimension(spark, pa.table({
        "model": pa.array([n for n, _ in items], pa.string()),
        "param_count": pa.array([p.param_count for _, p in items], pa.float64()),
        "batch_size": pa.array([p.batch_size for _, p in items], pa.float64()),
        "context_size": pa.array([p.context_size for _, p in items], pa.float64()),
        "allow_by_default": pa.array([p.allow_by_default for _, p in items], pa.bool_()),
        "allowed": pa.array([list(p.allowed_pii) for _, p in items], pa.list_(pa.string())),
    }))


def labels_table(spark: SparkSession, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """Class vocabularies ``(head, idx, label)``."""
    rows = [(head, i, label) for head, names in (labels or LABELS).items() for i, label in enumerate(names)]
    return dimension(spark, pa.table({
        "head": pa.array([r[0] for r in rows], pa.string()),
        "idx": pa.array([r[1] for r in rows], pa.int32()),
        "label": pa.array([r[2] for r in rows], pa.string()),
    }))


def load_label_file(path: str) -> list[tuple[int, str]]:
    """Read one label-map JSON file and check that both directions agree."""
    raw = json.loads(Path(path).read_text())
    forward = next(v for k, v in raw.items() if k.endswith("_to_idx"))
    backward = next(v for k, v in raw.items() if k.startswith("idx_to_"))
    pairs = sorted((int(i), label) for i, label in backward.items())
    if {label: i for i, label in pairs} != forward:
        raise ValueError(f"label map {path} is not a bijection")
    return pairs
