"""Probability calibration chosen on validation data and applied unchanged.

A fit is p' = sigmoid(slope * logit(p) + intercept) per label, optionally per kernel class. The sufficient
statistic is the score-block table; every Newton pass is one grouped aggregate of six sums over it. Only the
parameters (labels x kernel classes, i.e. bounded by the schema) visit the driver between passes.

The answer is the one minimum of the log loss. Where positives and negatives are *separated* (the least positive logit is not below the greatest
negative one; for ``temperature``, which has no intercept, positives are not below 0 and negatives not above) the loss has none: steeper is always better.
There the targets 1 and 0 become (n_pos + 1) / (n_pos + 2) and 1 / (n_neg + 2), as Platt proposed, which gives one minimum again. One class only, one
score only, and a minimum at a slope that is not positive (which would reverse the ranking) give the identity.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import logit, sigmoid

METHODS = ("none", "temperature", "platt")
ALL_KERNELS = "*"
PARAM_SCHEMA = "label string, kernel string, slope double, intercept double"


def identity(blocks: DataFrame) -> DataFrame:
    """Calibration ``none``: slope 1, intercept 0 for every label."""
    return blocks.select("label").distinct().select(
        "label", F.lit(ALL_KERNELS).alias("kernel"), F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"))


def fit(spark: SparkSession, val_long: DataFrame, method: str = "platt", *, by_kernel: bool = False,
        min_volumes: int = 100, max_passes: int = 50, tolerance: float = 1e-7) -> DataFrame:
    """Slope and intercept per label (kernel ``*``) and, with ``by_kernel``, per kernel class with enough volumes."""
    if method not in METHODS:
        raise ValueError(f"calibration must be one of {METHODS}, got {method!r}")
    blocks = score_table(val_long, by_kernel).persist()
    try:
        totals = separation(blocks, method)
        if by_kernel:
            sizes = {r["k"]: r["n"] for r in val_long.select("volume_id", F.col("kernel_class").cast("string").alias("k")).distinct()
                     .groupBy("k").count().withColumnRenamed("count", "n").collect()}
            totals = totals.filter((F.col("kernel") == ALL_KERNELS) | F.col("kernel").isin([k for k, n in sizes.items() if k is not None and n >= min_volumes]))
        params, active = {}, {}
        for r in totals.collect():
            params[r["label"], r["kernel"]] = (1.0, 0.0)
            if method != "none" and r["fittable"]:
                active[r["label"], r["kernel"]] = _Search(method == "platt", r["high"], r["low"])
        for _ in range(max_passes):
            if not active:
                break
            for key, *sums in _newton_sums(blocks, active):
                if active[key].advance(*sums, tolerance):
                    params[key] = active.pop(key).best
    finally:
        blocks.unpersist()
    rows = [(label, kernel, *((s, i) if s > 0 and math.isfinite(s) and math.isfinite(i) else (1.0, 0.0)))
            for (label, kernel), (s, i) in sorted(params.items())]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def score_table(val_long: DataFrame, by_kernel: bool = False) -> DataFrame:
    """(label, kernel, z, n, pos): rows and positives at each logit, for all kernels together and, on demand, for each."""
    known = val_long.filter(F.col("y").isNotNull())
    kernels = F.array(F.lit(ALL_KERNELS), F.col("kernel_class").cast("string")) if by_kernel else F.array(F.lit(ALL_KERNELS))
    base = known.groupBy("label", *(["kernel_class"] if by_kernel else []), "p").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("pos"))
    return base.select("label", F.explode(kernels).alias("kernel"), logit(F.col("p")).alias("z"), "n", "pos").filter(F.col("kernel").isNotNull())


def separation(blocks: DataFrame, method: str) -> DataFrame:
    """Per (label, kernel): whether there is something to fit, whether the classes are separated, and the targets ``high`` and ``low`` of the fit."""
    is_pos, is_neg = F.col("pos") > 0, F.col("n") > F.col("pos")
    ends = blocks.groupBy("label", "kernel").agg(
        F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.min("z").alias("least"), F.max("z").alias("most"),
        F.min(F.when(is_pos, F.col("z"))).alias("least_pos"), F.max(F.when(is_pos, F.col("z"))).alias("most_pos"),
        F.min(F.when(is_neg, F.col("z"))).alias("least_neg"), F.max(F.when(is_neg, F.col("z"))).alias("most_neg"))
    if method == "temperature":
        apart, reverse, flat = "least_pos >= 0 AND most_neg <= 0", "most_pos <= 0 AND least_neg >= 0", "least = 0 AND most = 0"
    else:
        apart, reverse, flat = "least_pos >= most_neg", "most_pos <= least_neg", "least = most"
    ends = ends.withColumn("separated", F.expr(f"coalesce({apart}, false)"))
    fittable = F.expr(f"n_pos > 0 AND n_neg > 0 AND NOT ({flat}) AND NOT ({reverse})")
    return ends.select("label", "kernel", "separated", fittable.alias("fittable"), F.when(F.col("separated"), (F.col("n_pos") + 1) / (F.col("n_pos") + 2)).otherwise(1.0).alias("high"),
                       F.when(F.col("separated"), 1 / (F.col("n_neg") + 2)).otherwise(0.0).alias("low"))


class _Search:
    """Newton's method with backtracking for one (label, kernel): a step that does not lower the loss is halved."""

    def __init__(self, intercept: bool, high: float, low: float):
        self.intercept, self.high, self.low = intercept, high, low
        self.best = self.trial = (1.0, 0.0)
        self.loss, self.step = math.inf, (0.0, 0.0)

    def advance(self, loss: float, g0: float, g1: float, h00: float, h01: float, h11: float, tolerance: float) -> bool:
        """Takes the sums at ``trial``; True when ``best`` is the minimum, as far as doubles tell."""
        small = max(map(abs, self.step)) <= tolerance * (1 + max(map(abs, self.best)))
        if loss > self.loss and not small:
            self.step = (self.step[0] / 2, self.step[1] / 2)
        else:
            self.best, self.loss = self.trial, loss
            det = h00 * h11 - h01 * h01
            if not self.intercept:
                self.step = (g0 / h00, 0.0) if h00 > 0 else (math.nan, 0.0)
            else:
                self.step = ((h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det) if det > 0 else (math.nan, math.nan)
            if not all(map(math.isfinite, self.step)):
                self.best = (1.0, 0.0)
                return True
            if max(map(abs, self.step)) <= tolerance * (1 + max(map(abs, self.best))):
                self.best = (self.best[0] - self.step[0], self.best[1] - self.step[1])  # Newton's last step squares the error
                return True
        self.trial = (self.best[0] - self.step[0], self.best[1] - self.step[1])
        return False


def _newton_sums(blocks: DataFrame, searches: dict):
    """Log loss, its gradient and Hessian sums per (label, kernel) at the trial parameters, which are literals of the plan."""
    entries = [x for (label, kernel), s in searches.items()
               for x in (F.lit(f"{label}\t{kernel}"), F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abhl", (*s.trial, s.high, s.low))]))]
    now = F.create_map(*entries)[F.concat_ws("\t", "label", "kernel")]
    rows = blocks.withColumn("_now", now).filter(F.col("_now").isNotNull())
    at = F.col("_now.a") * F.col("z") + F.col("_now.b")
    target = F.col("pos") * F.col("_now.h") + (F.col("n") - F.col("pos")) * F.col("_now.l")
    rows = rows.select("label", "kernel", "z", "n", target.alias("t"), at.alias("s"), sigmoid(at).alias("q"))
    rows = rows.select("label", "kernel", "z", (F.col("n") * (F.greatest("s", F.lit(0.0)) + F.log1p(F.exp(-F.abs("s")))) - F.col("t") * F.col("s")).alias("loss"),
                       (F.col("n") * F.col("q") - F.col("t")).alias("g"), (F.col("n") * F.col("q") * (F.lit(1.0) - F.col("q"))).alias("w"))
    out = rows.groupBy("label", "kernel").agg(F.sum("loss"), F.sum(F.col("g") * F.col("z")), F.sum("g"), F.sum(F.col("w") * F.col("z") * F.col("z")),
                                              F.sum(F.col("w") * F.col("z")), F.sum("w")).collect()
    return [((r[0], r[1]), *r[2:]) for r in out]


def residuals(val_long: DataFrame, params: DataFrame, method: str, *, by_kernel: bool = False) -> DataFrame:
    """Per row of ``params``: the gradient of the mean log loss at its slope and intercept, both 0 at the minimum, and how its targets were chosen
    (``exact``, ``smoothed`` where the classes are separated, ``identity`` where there was nothing to fit or the minimum would reverse the ranking)."""
    blocks = score_table(val_long, by_kernel)
    keys = ["label", "kernel"]
    rows = blocks.join(separation(blocks, method), keys).join(params, keys)
    off = F.col("n") * sigmoid(F.col("slope") * F.col("z") + F.col("intercept")) - F.col("pos") * F.col("high") - (F.col("n") - F.col("pos")) * F.col("low")
    none = ~F.col("fittable") | (F.col("slope") == 1.0) & (F.col("intercept") == 0.0)
    state = F.when(none, "identity").when(F.col("separated"), "smoothed").otherwise("exact")
    of = lambda x: F.when(F.first("state") == "identity", 0.0).otherwise(F.sum(x) / F.sum("n"))
    return rows.select(*keys, "z", "n", off.alias("off"), state.alias("state")).groupBy(*keys).agg(
        F.first("state").alias("targets"), of(F.col("off") * F.col("z")).alias("slope_residual"), (of(F.col("off")) if method == "platt" else F.lit(0.0)).alias("intercept_residual"))


def apply(long: DataFrame, params: DataFrame, out: str = "p_cal") -> DataFrame:
    """Adds the calibrated probability: the kernel's own fit where there is one, else the label's."""
    whole = params.filter(F.col("kernel") == ALL_KERNELS).select(F.col("label"), F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    own = params.filter(F.col("kernel") != ALL_KERNELS).select(
        F.col("label").alias("_label"), F.col("kernel").alias("_kernel"), F.col("slope").alias("_ks"), F.col("intercept").alias("_ki"))
    joined = long.join(whole, "label").join(
        own, (F.col("label") == F.col("_label")) & (F.col("kernel_class").cast("string") == F.col("_kernel")), "left")
    slope, intercept = F.coalesce("_ks", "_s"), F.coalesce("_ki", "_i")
    return joined.withColumn(out, sigmoid(logit(F.col("p")) * slope + intercept)).select(*long.columns, out)


def parameter_table(params: DataFrame, points: DataFrame, point_names: Sequence[str]) -> DataFrame:
    """Everything chosen on validation data, one row per label."""
    own: Column = F.struct("kernel", "slope", "intercept")
    cal = params.groupBy("label").agg(
        F.max(F.when(F.col("kernel") == ALL_KERNELS, F.col("slope"))).alias("slope"),
        F.max(F.when(F.col("kernel") == ALL_KERNELS, F.col("intercept"))).alias("intercept"),
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("kernel") != ALL_KERNELS, own)))).alias("per_kernel"))
    return cal.join(points, "label", "left").select("label", "slope", "intercept", "per_kernel", *point_names)
