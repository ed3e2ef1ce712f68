"""Embedding arithmetic on ARRAY columns: row-local, no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def unit(a: Column, floor: float = 1e-8) -> Column:
    """The array scaled to length 1. The norm is computed once per row: a lambda body runs per element."""
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(floor)), F.size(a)), lambda x, n: x / n)


def standardize(a: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
