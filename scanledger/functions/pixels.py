"""Row-local arithmetic on one slice's pixels (flat ARRAY<DOUBLE> of h * w, row by row): no shuffle.

Interpolation and blur are separable and work on whole rows, so each pixel costs a few array reads. A lambda body
runs per element, so anything constant for the slice is an array or column built outside of it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it in ``body``: an expression named inside a lambda is evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ..., n-1."""
    return F.sequence(F.lit(0), (n - 1).cast("int"))


def rows_of(pixels: Column, h: Column, w: Column) -> Column:
    return F.transform(upto(h), lambda r: F.slice(pixels, r * w + 1, w))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sample_points(n_in: Column, n_out: Column) -> Column:
    """Corner-aligned source position of every output index, as structs (lo, hi, f)."""
    step = F.greatest(n_out - 1, F.lit(1))

    def point(i):
        at = i * (n_in - 1).cast("double") / step
        lo = F.floor(at)
        return F.struct(lo.cast("int").alias("lo"), F.least(lo + 1, n_in - 1).cast("int").alias("hi"), (at - lo).alias("f"))
    return F.transform(upto(n_out), point)


def lerp(a: Column, b: Column, f: Column) -> Column:
    return (F.lit(1.0) - f) * a + f * b


def resize(pixels: Column, h: Column, w: Column, new_h: Column, new_w: Column) -> Column:
    """Corner-aligned bilinear resize."""
    def with_rows(rows):
        tall = F.transform(sample_points(h, new_h), lambda p: F.zip_with(
            F.get(rows, p["lo"]), F.get(rows, p["hi"]), lambda a, b: lerp(a, b, p["f"])))
        return bind(sample_points(w, new_w), lambda xs: F.flatten(F.transform(tall, lambda row: F.transform(
            xs, lambda p: lerp(F.get(row, p["lo"]), F.get(row, p["hi"]), p["f"])))))
    return bind(rows_of(pixels, h, w), with_rows)


def crop(pixels: Column, h: Column, w: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    """Rows y0..y1-1, columns x0..x1-1."""
    return F.flatten(F.transform(upto(y1 - y0), lambda r: F.slice(pixels, (r + y0) * w + x0 + 1, x1 - x0)))


def pad(pixels: Column, h: Column, w: Column, target_h: int, target_w: int, fill: Column) -> Column:
    """Centre the slice on a larger grid of ``fill``."""
    top, left = F.floor((F.lit(target_h) - h) / 2).cast("int"), F.floor((F.lit(target_w) - w) / 2).cast("int")
    body = F.flatten(F.transform(upto(h), lambda r: F.concat(
        F.array_repeat(fill, left), F.slice(pixels, r * w + 1, w), F.array_repeat(fill, F.lit(target_w) - left - w))))
    return F.concat(F.array_repeat(fill, top * target_w), body, F.array_repeat(fill, (F.lit(target_h) - top - h) * target_w))


def inner_laplacian(pixels: Column, h: Column, w: Column) -> Column:
    """Structs (center, lap) of the 4-neighbour Laplacian for the interior pixels, row by row."""
    inner_w = w - 2

    def cell(k):
        at = ((F.floor(k / inner_w) + 1) * w + k % inner_w + 1).cast("int")
        c = F.get(pixels, at)
        lap = F.lit(4.0) * c - F.get(pixels, at - w) - F.get(pixels, at + w) - F.get(pixels, at - 1) - F.get(pixels, at + 1)
        return F.struct(c.alias("center"), lap.alias("lap"))
    size = (h - 2) * inner_w
    empty = F.array().cast("array<struct<center:double,lap:double>>")
    return F.when(size > 0, F.transform(upto(size), cell)).otherwise(empty)


def above(pixels: Column, threshold: float) -> Column:
    """Flat indices of the pixels above a threshold."""
    return F.filter(F.transform(pixels, lambda v, i: F.when(v > threshold, i)), lambda i: i.isNotNull())


def gaussian_taps(sigma: Column) -> Column:
    """Normalised kernel of radius ceil(3 sigma): structs (k, g)."""
    radius = F.greatest(F.ceil(sigma * 3), F.lit(1)).cast("int")
    raw = F.transform(F.sequence(-radius, radius), lambda k: F.struct(k.alias("k"), F.exp(F.lit(-0.5) * (k / sigma) * (k / sigma)).alias("g")))
    norm = F.aggregate(raw, F.lit(0.0), lambda a, t: a + t["g"])
    return F.zip_with(raw, F.array_repeat(norm, F.size(raw)), lambda t, s: F.struct(t["k"].alias("k"), (t["g"] / s).alias("g")))


def reflected(i: Column, n: Column) -> Column:
    """Index mirrored at the edges without repeating them."""
    j = F.abs(i)
    return F.when(j > n - 1, (n - 1) * 2 - j).otherwise(j).cast("int")


def blur(pixels: Column, h: Column, w: Column, taps: Column) -> Column:
    """Separable convolution with reflected edges: columns first, then rows."""
    def with_rows(rows):
        tall = F.transform(upto(h), lambda r: F.aggregate(taps, F.array_repeat(F.lit(0.0), w), lambda acc, t: F.zip_with(
            acc, F.get(rows, reflected(r + t["k"], h)), lambda a, b: a + t["g"] * b)))
        return F.flatten(F.transform(tall, lambda row: F.transform(upto(w), lambda c: F.aggregate(
            taps, F.lit(0.0), lambda acc, t: acc + t["g"] * F.get(row, reflected(c + t["k"], w))))))
    return bind(rows_of(pixels, h, w), with_rows)


def sharpen(pixels: Column, blurred: Column, amount: Column) -> Column:
    """Unsharp mask: x + amount * (x - blurred)."""
    return F.zip_with(pixels, blurred, lambda x, b: x + amount * (x - b))
