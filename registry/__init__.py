"""Registered queries: library operators on the given tables, each beside its SQL form.

Every module fills a ``Registry``; ``__spark_entry__`` merges them.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures_sql import VIEWS_SQL


def with_views(body: str, changed: dict[str, str] | None = None) -> str:
    """Prefix the fixture views a statement uses (transitively) as CTEs, in dependency order; ``changed`` adds or replaces views."""
    views = {**VIEWS_SQL, **(changed or {})}
    order: list[str] = []

    def visit(text: str):
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(views[name])
                if name not in order:
                    order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: dict[str, str] | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = with_views(sql, views)
            return fn
        return register
