"""Registered queries and, where SQL can express them, their check queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("routing", "vectors", "metering", "evaluation", "corpus", "streams", "files", "training")


def _merged(name: str) -> dict:
    out = {}
    for module in MODULES:
        out.update(getattr(import_module(f"{__name__}.{module}"), name))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
