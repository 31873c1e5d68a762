"""Operators for preparing training data. Nothing outside this folder imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pii", "quality", "mixing", "chat", "html_extract", "lines", "decontam", "substr", "simhash", "lm")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLES.items()}
