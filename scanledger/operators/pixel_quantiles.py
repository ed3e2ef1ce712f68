"""Exact quantiles of a volume's pixels from histograms; no pixel becomes a row and no pixel is shuffled.

A number's 64 bits, with those of negative numbers turned, are a key that sorts like the numbers. Each level of 16 bits is one pass over the
slices: tasks count the keys of their slices by the bits down to that level, among the intervals that the wanted ranks fell into on the level
before, and a volume adds up its tasks' counts and narrows the intervals. An interval whose least and greatest key are equal is settled, so
whole numbers below 2^21 take two passes and any number takes four. Volumes that are settled are read no further.

What leaves a task is at most 65,536 counts per volume and wanted rank; what a task keeps at once is bounded by ``KEPT`` counts.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import staged

SHIFTS = (48, 32, 16, 0)
KEPT = 1 << 20
TURN = np.int64(2**63 - 1)
COUNTS = "keys array<bigint>, counts array<bigint>, low array<bigint>, high array<bigint>"
STATE = "n bigint, ranks array<bigint>, prefix array<bigint>, below array<bigint>, least array<bigint>, settled boolean"


class Counts(NamedTuple):
    """Distinct keys in order, with how many numbers each stands for and the least and greatest of their full keys."""
    keys: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray


def order_keys(values: np.ndarray) -> np.ndarray:
    bits = (values + 0.0).view(np.int64)  # adding zero makes both zeros one
    return np.where(bits < 0, bits ^ TURN, bits)


def numbers(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ TURN, keys).view(np.float64)


def count(full: np.ndarray, shift: int) -> Counts:
    full = np.sort(full)
    keys = full >> shift
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    last = np.r_[first[1:], len(full)]
    return Counts(keys[first], last - first, full[first], full[last - 1])


def merge(parts: Sequence[Counts]) -> Counts:
    keys = np.concatenate([p.keys for p in parts])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    counts, low, high = (np.concatenate([getattr(p, c) for p in parts])[order] for c in ("counts", "low", "high"))
    return Counts(keys[order][first], np.add.reduceat(counts, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first))


def _task_counts(shift: int, known: int | None):
    """For ``mapInArrow`` over (volume_id, pixels, targets): counts per volume of the task, in several rows where they are many."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[object, Counts] = {}

        def out(kind: pa.DataType) -> pa.RecordBatch:
            lists = [pa.array([getattr(c, f) for c in kept.values()], pa.list_(pa.int64())) for f in Counts._fields]
            return pa.RecordBatch.from_arrays([pa.array(list(kept), kind), *lists], ["volume_id", *Counts._fields])

        kind = None
        for batch in batches:
            kind = batch.schema.field("volume_id").type
            pixels = batch.column("pixels")
            flat, ends = np.asarray(pixels.values.to_numpy(zero_copy_only=False), np.float64), pixels.offsets.to_numpy()
            targets = batch.column("targets").to_pylist()
            for i, volume in enumerate(batch.column("volume_id").to_pylist()):
                values = flat[ends[i]:ends[i + 1]]
                full = order_keys(values[~np.isnan(values)])
                if known is not None:
                    full = full[np.isin(full >> known, targets[i])]
                if len(full):
                    own = count(full, shift)
                    kept[volume] = merge([kept[volume], own]) if volume in kept else own
            if sum(len(c.keys) for c in kept.values()) > KEPT:
                yield out(kind)
                kept.clear()
        if kept:
            yield out(kind)
    return run


def narrow(state: dict | None, found: Counts, shift: int, known: int | None, probs: Sequence[float]) -> dict:
    """The intervals of the wanted ranks one level down."""
    upto = np.cumsum(found.counts)
    if state is None:
        n = int(upto[-1])
        ranks = np.array(sorted({int(f(q * (n - 1))) for q in probs for f in (np.floor, np.ceil)}))
        below, start, base = np.zeros(len(ranks), np.int64), 0, 0
    else:
        n, ranks, below = state["n"], np.asarray(state["ranks"]), np.asarray(state["below"])
        start = np.searchsorted(found.keys >> (known - shift), np.asarray(state["prefix"]))
        base = np.where(start > 0, upto[start - 1], 0)
    at = np.searchsorted(upto, base + ranks - below, side="right")
    below = below + upto[at] - found.counts[at] - base
    return {"n": n, "ranks": ranks, "prefix": found.keys[at], "below": below, "least": found.low[at], "settled": bool((found.low[at] == found.high[at]).all())}


def _state_row(pieces: pd.DataFrame, state: dict | None, shift: int, known: int | None, probs: Sequence[float]) -> pd.DataFrame:
    found = merge([Counts(*(np.asarray(p) for p in row)) for row in pieces[list(Counts._fields)].itertuples(index=False)])
    return pd.DataFrame([{"volume_id": pieces["volume_id"].iloc[0], **narrow(state, found, shift, known, probs)}])


def _first_level(shift: int, probs: Sequence[float]):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        return _state_row(pieces, None, shift, None, probs)
    return run


def _next_level(shift: int, known: int, probs: Sequence[float]):
    def run(pieces: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return _state_row(pieces, before.iloc[0].to_dict(), shift, known, probs)
    return run


def value_quantiles(slices: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Quantiles ``probs`` (name to share) per ``volume_id`` with linear interpolation over all ``pixels``.

    NULL and NaN pixels and NULL volumes are left out; a volume without a number has no row; between two infinities the answer is NaN. Runs a job per level, two to four in all.
    """
    key = slices.schema["volume_id"].dataType
    wanted = list(probs.values())
    rows = slices.filter("volume_id IS NOT NULL").select("volume_id", F.coalesce(F.col("pixels").cast("array<double>"), F.array().cast("array<double>")).alias("pixels"))
    state_type = T.StructType([T.StructField("volume_id", key), *T._parse_datatype_string(STATE).fields])
    counts_type = T.StructType([T.StructField("volume_id", key), *T._parse_datatype_string(COUNTS).fields])
    done, state, known = None, None, None
    for shift in SHIFTS:
        if state is None:
            pieces = rows.withColumn("targets", F.array().cast("array<bigint>")).mapInArrow(_task_counts(shift, known), counts_type)
            state = pieces.groupBy("volume_id").applyInPandas(_first_level(shift, wanted), state_type)
        else:
            held = rows.join(state.select("volume_id", F.col("prefix").alias("targets")), "volume_id").select("volume_id", "pixels", "targets")
            pieces = held.mapInArrow(_task_counts(shift, known), counts_type)
            state = pieces.groupBy("volume_id").cogroup(state.groupBy("volume_id")).applyInPandas(_next_level(shift, known, wanted), state_type)
        known = shift
        state = staged(state)
        settled = state.filter("settled")
        done = settled if done is None else done.unionByName(settled)
        state = state.filter("NOT settled")
        if state.isEmpty():
            break

    @F.pandas_udf("array<double>")
    def values(n: pd.Series, ranks: pd.Series, least: pd.Series) -> pd.Series:
        out = []
        for total, places, keys in zip(n, ranks, least):
            at = dict(zip((int(p) for p in places), numbers(np.asarray(keys, np.int64))))
            spots = [q * (total - 1) for q in wanted]
            out.append([float(at[int(np.floor(s))] + (at[int(np.ceil(s))] - at[int(np.floor(s))]) * (s - np.floor(s))) for s in spots])
        return pd.Series(out)

    return done.withColumn("_q", values("n", "ranks", "least")).select("volume_id", *[F.coalesce(F.col("_q")[i], F.lit(float("nan"))).alias(name) for i, name in enumerate(probs)])
