"""Checks return the offending rows as a DataFrame; turning them into an error is one small action."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class CheckFailed(ValueError):
    """A check found offending rows."""


def assert_empty(offending: DataFrame, message: str, show: int = 5) -> None:
    rows = offending.limit(show).collect()
    if rows:
        raise CheckFailed(f"{message}: e.g. {[tuple(r) for r in rows]}")


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CheckFailed(f"{what} lacks column(s) {missing}")
