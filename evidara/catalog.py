"""Every registered query of the library with its SQL, gathered from the families."""

from __future__ import annotations

from evidara.queries import corpus, flows, scores, signals, timeline  # noqa: F401  registers itself
from evidara.queries.registry import REGISTERED


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}


def flagship(spark, sf_dir: str):
    """Leave-one-subject-out split with unique texts."""
    return REGISTERED["split_loso_unique_text"][0](spark, sf_dir)
