"""Bootstrap intervals of AUROC and AUPRC over resamples of patients.

A resample gives every patient a Poisson(1) weight, the form of the bootstrap in which a patient's weight does not depend on
how many others there are. Resample b maps the patient's 31-bit hash h to ``(a_b * h + c_b) mod (2^31 - 1)`` with a_b and c_b
from md5 of ``seed:b``; its 16 high bits are the uniform draw. Weights are thus known from a row alone, in every group alike.

Rows are never multiplied by the resamples before a shuffle. The scores of a label are cut into slices in score order (one score
with more rows than a slice should hold is a slice of its own, whose order does not matter, so its rows are salted over tasks).
Weight vectors are made inside the tasks; what leaves a task is a few vectors per slice. With ``MAX_SLICES`` slices per label a
task reads at most ``2 / MAX_SLICES`` of the rows of a label, and one task adds up at most ``2 * MAX_SLICES`` vectors of a label.

Rows without a label value, a score or a patient are left out. A resample with one class only has no value.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import hash32
from .predictions import by_group
from .ranking import grouped_blocks, rank_blocks

PRIME = 2**31 - 1
MAX_SLICES, SLICE_ROWS, SALTS, CHUNK = 512, 4096, 64, 1024
# fixed values: 16-bit draws at which a Poisson(1) weight becomes 1, 2, ...
POISSON_CUTS = (24110, 48219, 60274, 64292, 65297, 65498, 65531, 65536)
KEYS = ("group_by", "group", "label")
KEY_SCHEMA = "group_by string, group string, label string"
METRICS = ("auroc", "auprc")


def _weight_table() -> np.ndarray:
    return np.searchsorted(np.array(POISSON_CUTS), np.arange(65536), side="right").astype(np.float64)


def _resamples(n_boot: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    digests = [hashlib.md5(f"{seed}:{b}".encode()).hexdigest() for b in range(n_boot)]
    return (np.array([int(d[:8], 16) % (PRIME - 1) + 1 for d in digests], dtype=np.int64),
            np.array([int(d[8:16], 16) % PRIME for d in digests], dtype=np.int64))


def _chunks(rows: pd.DataFrame, n_boot: int, seed: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Pieces of the rows with their weights, a row of ``n_boot`` numbers each."""
    a, c = _resamples(n_boot, seed)
    table = _weight_table()
    for start in range(0, len(rows), CHUNK):
        piece = rows.iloc[start:start + CHUNK]
        draw = (piece["h"].to_numpy(np.int64)[:, None] * a + c) % PRIME >> 15
        yield piece, table[draw] * piece["k"].to_numpy(np.float64)[:, None]


def draws(long: DataFrame, n_boot: int, seed: int = 0, group_columns: Sequence[str] = (), groups: DataFrame | None = None) -> DataFrame:
    """``auroc`` and ``auprc`` of every resample ``b`` per (group_by, group, label); ``groups`` keeps only those groups."""
    keys = list(KEYS)
    known = long.filter("y IS NOT NULL AND p IS NOT NULL AND patient_id IS NOT NULL")
    blocks = rank_blocks(grouped_blocks(known, group_columns), keys)
    combined = known.groupBy("patient_id", "label", *group_columns, "p", "y").agg(F.count(F.lit(1)).alias("k"))
    rows = by_group(combined.withColumn("h", hash32(F.col("patient_id").cast("string")) % PRIME), group_columns, ["label", "p", "y", "k", "h"])
    if groups is not None:
        blocks, rows = (x.join(groups.select("group_by", "group"), ["group_by", "group"], "left_semi") for x in (blocks, rows))
    width = F.greatest(F.lit(SLICE_ROWS), F.ceil(F.col("n_total") / MAX_SLICES))
    part = (2 * F.floor(F.col("n_before") / width) + F.when(F.col("n") > width, 1).otherwise(0)).alias("slice")
    starts = blocks.select(*keys, "p", part).groupBy(*keys, "slice").agg(F.min("p").alias("start"))
    starts = starts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "slice"))).alias("starts"))
    reached = F.filter("starts", lambda s: s["start"] <= F.col("p"))
    rows = rows.join(starts, keys).withColumn("slice", F.element_at(reached, -1)["slice"]).drop("starts")
    salted = rows.withColumn("salt", F.when(F.col("slice") % 2 == 1, F.col("h") % SALTS).otherwise(0))

    def totals(rows: pd.DataFrame) -> pd.DataFrame:
        pos, n = np.zeros(n_boot), np.zeros(n_boot)
        for piece, w in _chunks(rows, n_boot, seed):
            n += w.sum(axis=0)
            pos += w[piece["y"].to_numpy() == 1].sum(axis=0)
        return rows.head(1)[[*keys, "slice"]].assign(pos=[pos], n=[n])

    def offsets(sums: pd.DataFrame) -> pd.DataFrame:
        """Weights of the slice and of all slices above it."""
        out, pos, n = [], np.zeros(n_boot), np.zeros(n_boot)
        for number, same in sorted(sums.groupby("slice"), key=lambda x: -x[0]):
            own_pos, own_n = np.sum(np.stack(same["pos"]), axis=0), np.sum(np.stack(same["n"]), axis=0)
            out.append(same.head(1)[[*keys, "slice"]].assign(pos=[own_pos], n=[own_n], pos_above=[pos], n_above=[n]))
            pos, n = pos + own_pos, n + own_n
        return pd.concat(out)

    def slice_parts(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        """Twice the ordered pairs (negative below positive, ties half) and the unscaled average precision of one slice."""
        own = above.iloc[0]
        pairs, precision = np.zeros(n_boot), np.zeros(n_boot)
        pos_above, n_above = np.array(own["pos_above"]), np.array(own["n_above"])

        def take(pos: np.ndarray, n: np.ndarray) -> None:
            nonlocal pairs, precision, pos_above, n_above
            pos_to, n_to = pos_above + np.cumsum(pos, axis=0), n_above + np.cumsum(n, axis=0)
            pairs += ((n - pos) * (2 * pos_to - pos)).sum(axis=0)
            precision += (pos * pos_to / np.maximum(n_to, 1)).sum(axis=0)
            pos_above, n_above = pos_to[-1], n_to[-1]

        if own["slice"] % 2 == 1:
            take(np.array(own["pos"])[None, :], np.array(own["n"])[None, :])
        else:
            rows = rows.sort_values("p", ascending=False, kind="stable")
            last, open_pos, open_n = None, np.zeros((0, n_boot)), np.zeros((0, n_boot))
            for piece, w in _chunks(rows, n_boot, seed):
                p = piece["p"].to_numpy()
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                n = np.add.reduceat(w, first, axis=0)
                pos = np.add.reduceat(w * (piece["y"].to_numpy() == 1)[:, None], first, axis=0)
                if last is not None and last == p[0]:
                    n[0] += open_n[0]
                    pos[0] += open_pos[0]
                elif last is not None:
                    take(open_pos, open_n)
                if len(first) > 1:
                    take(pos[:-1], n[:-1])
                last, open_pos, open_n = p[-1], pos[-1:], n[-1:]
            take(open_pos, open_n)
        return above.head(1)[keys].assign(pos=[own["pos"]], n=[own["n"]], pairs=[pairs], precision=[precision])

    def values(parts: pd.DataFrame) -> pd.DataFrame:
        pos, n, pairs, precision = (np.sum(np.stack(parts[c]), axis=0) for c in ("pos", "n", "pairs", "precision"))
        scorable = (pos > 0) & (n > pos)
        safe = np.where(scorable, pos, 1)
        auroc = pairs / (2 * safe * np.where(scorable, n - pos, 1))
        keep = np.flatnonzero(scorable)
        out = pd.DataFrame({"b": keep, "auroc": auroc[keep], "auprc": (precision / safe)[keep]})
        for k in keys:
            out[k] = parts[k].iloc[0]
        return out[[*keys, "b", *METRICS]]

    vectors = "pos array<double>, n array<double>"
    sums = salted.groupBy(*keys, "slice", "salt").applyInPandas(totals, f"{KEY_SCHEMA}, slice bigint, {vectors}")
    above = sums.groupBy(*keys).applyInPandas(offsets, f"{KEY_SCHEMA}, slice bigint, {vectors}, pos_above array<double>, n_above array<double>")
    ordered = rows.filter("slice % 2 = 0").select(*keys, "slice", "p", "y", "k", "h")
    parts = ordered.groupBy(*keys, "slice").cogroup(above.groupBy(*keys, "slice")).applyInPandas(
        slice_parts, f"{KEY_SCHEMA}, {vectors}, pairs array<double>, precision array<double>")
    return parts.groupBy(*keys).applyInPandas(values, f"{KEY_SCHEMA}, b bigint, auroc double, auprc double")


def intervals(drawn: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval of both metrics per key; a key has one value per resample (and label)."""
    ends = {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2}
    return drawn.groupBy(*keys).agg(*[F.percentile(m, F.lit(q)).alias(f"{m}_{end}") for m in METRICS for end, q in ends.items()])


def label_intervals(long: DataFrame, n_boot: int, seed: int = 0, **options) -> DataFrame:
    """Intervals per (group_by, group, label)."""
    return intervals(draws(long, n_boot, seed, **options), KEYS)


def macro_intervals(long: DataFrame, n_boot: int, seed: int = 0, **options) -> DataFrame:
    """Intervals per (group_by, group) of the mean over the labels that a resample could score."""
    means = draws(long, n_boot, seed, **options).groupBy("group_by", "group", "b").agg(*[F.avg(m).alias(m) for m in METRICS])
    return intervals(means, ["group_by", "group"])
