"""All registered queries (importing a plan module registers its queries)."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

PLAN_MODULES = ["prep", "profiling", "fitapply", "evaluation", "columns", "neighbours", "imputation", "modelling", "attribution", "training", "streams"]


def _load() -> None:
    for m in PLAN_MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLE)
