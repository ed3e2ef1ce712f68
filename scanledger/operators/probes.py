"""Linear probes on mean embeddings: kernel probe, label probe, weighted classifier, PCA.

All labels (or folds) of a probe are fitted together by Newton's method: each pass is one aggregate of the loss, gradient and Hessian of every target,
so the number of jobs does not depend on how many there are. A target is one entry of an array ``ys``; NULL there leaves the row out of it.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import order_key
from .ordering import hash_cell, positions
from .ranking import auroc_expr, rank_blocks, score_blocks


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("emb"))


def pca_scores(means: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """First k principal components of centred volume means, and each component's share of the variance.

    A component's sign is chosen so that its loading of greatest size is positive (the first such loading, if some are equal).
    """
    rows = _vectors(means)
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    share = [float(v) for v in model.explainedVariance]
    loadings = model.pc.toArray()
    sign = np.where(np.take_along_axis(loadings, np.abs(loadings).argmax(axis=0)[None, :], axis=0)[0] < 0, -1.0, 1.0)
    scored = model.transform(centred).withColumn("pc", vector_to_array("pc"))
    return scored.select("volume_id", *[(F.col("pc")[i] * float(sign[i])).alias(f"pc{i + 1}") for i in range(k)]), share


class Probe(NamedTuple):
    """One fitted target: rows, positives, and the model on standardised features (None where a class is missing)."""
    n: int
    n_pos: int
    mean: np.ndarray | None
    scale: np.ndarray | None
    beta: np.ndarray | None  # intercept first
    positive_weight: float = 1.0
    penalty: float = 0.0

    def raw(self) -> np.ndarray:
        """The same model on the features as they are."""
        slopes = self.beta[1:] * self.scale
        return np.concatenate([[self.beta[0] - slopes @ self.mean], slopes])


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(1, embedding) and targets (NaN where left out) of a batch of (emb, ys)."""
    n = len(batch)
    emb, ys = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for k in (0, 1))
    return np.concatenate([np.ones((n, 1)), emb], axis=1), ys


def _sums(rows: DataFrame, theta: dict[int, np.ndarray] | None, weight: dict[int, float]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian of each target at its coefficients (all zero for None); (emb, ys) rows, a set of sums from every task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            u, ys = _features(batch)
            for t in range(ys.shape[1]) if theta is None else theta:
                known = ~np.isnan(ys[:, t])
                x, y = u[known], ys[known, t]
                z = np.zeros(len(y)) if theta is None else x @ theta[t]
                p, w = 1 / (1 + np.exp(-np.clip(z, -500, 500))), np.where(y == 1, weight.get(t, 1.0), 1.0)
                part = np.concatenate([[w @ (np.logaddexp(0, z) - y * z)], x.T @ (w * (p - y)), (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()])
                total[t] = total.get(t, 0) + part
        for t, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), t, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                                             ["target", "place", "value"])

    found: dict[int, dict[int, float]] = {}
    for r in rows.mapInArrow(add, "target int, place int, value double").groupBy("target", "place").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r.target, {})[r.place] = r.value
    out = {}
    for t, values in found.items():
        flat = np.array([values[k] for k in range(len(values))])
        d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2 + 0.5)  # 1 + d + d * d numbers
        out[t] = float(flat[0]), flat[1:d + 1], flat[d + 1:].reshape(d, d)
    return out


def fit_probes(rows: DataFrame, C: float, weighted: bool = False, most_passes: int = 60) -> dict[int, Probe]:
    """Logistic regressions of all targets of (emb, ys) on standardised features.

    The penalty C counts against the summed loss, the intercept is free. With ``weighted`` a positive counts as many times as there are negatives
    per positive. The minimum is unique; a pass beyond the last step halves the steps of targets whose loss grew.
    """
    rows = rows.filter("emb IS NOT NULL").select("emb", "ys").persist()
    try:
        probes, old, step = {}, {}, {}
        for t, (_, gradient, hessian) in _sums(rows, None, {}).items():
            n, moments = int(round(4 * hessian[0, 0])), 4 * hessian
            n_pos = int(round(n / 2 - gradient[0]))
            if not 0 < n_pos < n:
                probes[t] = Probe(n, n_pos, None, None, None)
                continue
            mean = moments[0, 1:] / n
            deviation = np.sqrt(np.maximum(np.diag(moments)[1:] / n - mean ** 2, 0) * n / (n - 1))
            flat = deviation <= 1e-9 * np.maximum(np.abs(mean), 1e-300)
            weight = (n - n_pos) / n_pos if weighted else 1.0
            probes[t] = Probe(n, n_pos, mean, np.where(flat, 0.0, 1 / np.where(flat, 1.0, deviation)), np.zeros(len(mean) + 1), weight,
                              (n - n_pos + weight * n_pos) / (C * n))
        weights, open_targets = {t: p.positive_weight for t, p in probes.items()}, {t for t, p in probes.items() if p.beta is not None}
        for _ in range(most_passes):
            if not open_targets:
                break
            for t, (loss, gradient, hessian) in _sums(rows, {t: probes[t].raw() for t in sorted(open_targets)}, weights).items():
                probe = probes[t]
                to_raw = np.diag(np.concatenate([[1.0], probe.scale]))
                to_raw[0, 1:] = -probe.scale * probe.mean
                pull = np.full(len(probe.beta), probe.penalty)
                pull[0] = 0
                loss += 0.5 * pull @ probe.beta ** 2
                if t in old and loss > old[t][0] + 1e-12 * abs(old[t][0]):
                    step[t] = step[t] / 2
                    if np.abs(step[t]).max() < 1e-14:
                        open_targets.discard(t)
                    probes[t] = probe._replace(beta=old[t][1] + step[t])
                    continue
                slope, bend = to_raw.T @ gradient + pull * probe.beta, to_raw.T @ hessian @ to_raw + np.diag(pull)
                if np.abs(slope).max() < 1e-8 * probe.n:  # so near, a last step squares what is left
                    open_targets.discard(t)
                old[t], step[t] = (loss, probe.beta), -np.linalg.solve(bend, slope)
                probes[t] = probe._replace(beta=probe.beta + step[t])
        return probes
    finally:
        rows.unpersist()


def predict(probes: dict[int, Probe], rows: DataFrame) -> DataFrame:
    """target, p and y for every known target of (emb, ys) rows that was fitted."""
    models = {t: p.raw() for t, p in probes.items() if p.beta is not None}

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            u, ys = _features(batch)
            for t, theta in models.items():
                known = ~np.isnan(ys[:, t])
                p = 1 / (1 + np.exp(-np.clip(u[known] @ theta, -500, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t, np.int32)), pa.array(p), pa.array(ys[known, t])], ["target", "p", "y"])

    return rows.filter("emb IS NOT NULL").select("emb", "ys").mapInArrow(rate, "target int, p double, y double")


def auroc(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    return rank_blocks(score_blocks(scored, keys), keys).groupBy(*keys).agg(auroc_expr().alias("auroc"))


def kernel_probe(means: DataFrame, classes: tuple[str, str] = ("sharp", "soft"), folds: int = 5, C: float = 0.1, seed: int = 0) -> DataFrame:
    """Cross-validated AUROC of telling the second kernel class from the first; NULL when a class is too small.

    Folds are stratified: every class is dealt out in its seeded order.
    """
    rows = means.filter(F.col("kernel_class").isin(*classes)).withColumn("y", (F.col("kernel_class") == classes[1]).cast("double")).withColumn(
        "_key", order_key(seed, "volume_id"))
    dealt = positions(rows, ["y"], hash_cell(F.col("_key")), ["_key", "volume_id"], "_p").withColumn("fold", (F.col("_p") % folds).cast("int")).drop("_key").persist()
    try:
        sizes = [r[0] for r in dealt.groupBy("y").count().select("count").collect()]
        spark = means.sparkSession
        if len(sizes) < 2 or min(sizes) < folds:
            return spark.createDataFrame([(0, None)], "folds int, auroc double")
        of = F.array(*[F.when(F.col("fold") == k, F.col("y")) for k in range(folds)])
        rest = F.array(*[F.when(F.col("fold") != k, F.col("y")) for k in range(folds)])
        probes = fit_probes(dealt.select("emb", rest.alias("ys")), C)
        values = [r["auroc"] for r in auroc(predict(probes, dealt.select("emb", of.alias("ys"))), ["target"]).collect()]
        return spark.createDataFrame([(folds, sum(values) / folds)], "folds int, auroc double")
    finally:
        dealt.unpersist()


def linear_probe(spark: SparkSession, train: DataFrame, test: DataFrame, labels: Sequence[str], C: float = 0.01, weighted: bool = False) -> DataFrame:
    """Per label: rows used and test AUROC of a logistic regression; NULL when train or test holds one class.

    Both frames have volume_id, emb and ``label_<name>`` columns with NULL for a missing label. With ``weighted``,
    a positive counts as many times as there are negatives per positive.
    """
    ys = F.array(*[F.col(f"label_{name}").cast("double") for name in labels]).alias("ys")
    probes = fit_probes(train.select("emb", ys), C, weighted)
    known = test.select(*[F.count(f"label_{name}").alias(f"n{t}") for t, name in enumerate(labels)]).first()
    values = {r["target"]: r["auroc"] for r in auroc(predict(probes, test.select("emb", ys)), ["target"]).collect()}
    return spark.createDataFrame([(name, probes[t].n if t in probes else 0, known[t], values.get(t)) for t, name in enumerate(labels)],
                                 "label string, n_train bigint, n_test bigint, auroc double")


def score_equations(train: DataFrame, labels: Sequence[str], C: float = 0.01, weighted: bool = False) -> DataFrame:
    """label, place and the slope of the penalised loss there at the fitted model, summed over the rows by plain expressions; all are 0 at the minimum."""
    probes, out = fit_probes(train.select("emb", F.array(*[F.col(f"label_{name}").cast("double") for name in labels]).alias("ys")), C, weighted), None
    for t, name in enumerate(labels):
        probe = probes.get(t)
        if probe is None or probe.beta is None:
            continue
        listed = lambda values: F.array(*[F.lit(float(v)) for v in values])
        y = F.col(f"label_{name}").cast("double")
        z = F.zip_with(F.zip_with("emb", listed(probe.mean), lambda a, b: a - b), listed(probe.scale), lambda a, b: a * b)
        rows = train.filter(y.isNotNull() & F.col("emb").isNotNull()).select(y.alias("y"), F.concat(F.array(F.lit(1.0)), z).alias("z"))
        score = F.aggregate(F.zip_with("z", listed(probe.beta), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        error = (F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - F.col("y")) * F.when(F.col("y") == 1, probe.positive_weight).otherwise(1.0)
        terms = rows.select(error.alias("e"), F.posexplode("z").alias("place", "v")).groupBy("place").agg(F.sum(F.col("e") * F.col("v")).alias("slope"))
        pull = listed([0.0, *(probe.penalty * probe.beta[1:])])
        part = terms.select(F.lit(name).alias("label"), "place", (F.col("slope") + F.get(pull, F.col("place"))).alias("slope"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else train.sparkSession.createDataFrame([], "label string, place int, slope double")
