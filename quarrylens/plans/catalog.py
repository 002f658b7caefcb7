"""All registered queries and their DuckDB oracle SQL, by area."""

from __future__ import annotations

import importlib

AREAS = [
    "quarrylens.plans.trend_queries",
    "quarrylens.plans.clean_queries",
    "quarrylens.plans.model_queries",
    "quarrylens.plans.qa_queries",
    "quarrylens.plans.study_queries",
    "quarrylens.plans.eval_queries",
    "quarrylens.plans.scoring_queries",
]


def _merge(attr: str) -> dict:
    out: dict = {}
    for name in AREAS:
        mod = importlib.import_module(name)
        for key, value in getattr(mod, attr).items():
            if key in out:
                raise ValueError(f"duplicate query name {key}")
            out[key] = value
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracle_sql() -> dict:
    return _merge("ORACLE")
