"""One table of queries: name -> (callable, SQL or None)."""

from __future__ import annotations

from evidara.plans.views import duck

REGISTERED: dict = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Register a function (spark, sf_dir) under ``name``; ``sql`` is DuckDB SQL over ``views``."""

    def add(f):
        REGISTERED[name] = f, None if sql is None else duck(views, sql)
        return f

    return add
