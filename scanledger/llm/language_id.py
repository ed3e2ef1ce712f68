"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are all sequences of 2, 3 and 4 bytes of the text in lower case (A-Z), hashed into ``BUCKETS`` rows of an embedding table. A
document is the average of its rows, a linear layer gives one score per language, and the probabilities are divided by a temperature
that is fitted on documents kept out of the training. Embeddings and layer are trained together by stochastic gradient descent
in numpy, on a bounded sample of labelled documents (``PER_LANGUAGE`` and ``MOST`` documents) and random pieces of them, so that
short texts are learned too. For prediction the two are multiplied into one table with a column per language, which gives the same
numbers; it is applied to the whole of every text inside Spark tasks.

Defined results: NULL texts and texts without a letter are ``und`` with score 0, as is everything when no labelled document exists; a text with
a letter gets one of the learned languages. Repeated rows get the same result. ``accepted`` says whether the calibrated
probability reaches the rejection threshold, which lies below all but a share of
``REJECT`` of the held-out sample and is ``MOST_REJECTED`` at most.
Columns of the input pass through; one with a result's name is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .arrays import LOWER, chunks, text_bytes
from .sampling import labelled_sample
from .words import crc_slot, fresh

BUCKETS, DIMENSIONS, SIZES = 1 << 14, 16, (2, 3, 4)
PER_LANGUAGE, MOST = 400, 2400
REJECT, MOST_REJECTED = 0.001, 0.4
UNDETERMINED = "und"
FOLDS = 5


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every byte position and size (SIZES x bytes, BUCKETS where a subword would leave its row), and subwords per row."""
    n, length = len(data), np.diff(offsets)
    wide = np.concatenate([LOWER[data], np.zeros(4, np.uint8)]).astype(np.uint32)
    out, value = [], wide[:n].copy()
    for size in range(2, max(SIZES) + 1):
        value |= wide[size - 1:n + size - 1] << np.uint32(8 * (size - 1))
        if size in SIZES:
            bucket = ((value * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(32 - 14)).astype(np.int32)
            for back in range(1, size):
                at = offsets[1:] - back
                bucket[at[at >= offsets[:-1]]] = BUCKETS
            out.append(bucket)
    return np.stack(out), sum(np.maximum(length - size + 1, 0) for size in SIZES)


def row_sums(table: np.ndarray, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of table rows over each document; the last row of the table is for BUCKETS."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    some = np.flatnonzero(np.diff(offsets) > 0)
    for b in buckets:
        if len(some):
            out[some] += np.add.reduceat(table[b], offsets[some], axis=0)
    return out


class LanguageModel(NamedTuple):
    languages: list[str]
    table: np.ndarray  # BUCKETS + 1 rows, one column per language
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for _, _, part, offs in chunks(data, offsets):
            buckets, n = subwords(part, offs)
            out.append(softmax((row_sums(self.table, buckets, offs) / np.maximum(n, 1)[:, None] + self.bias) / self.temperature))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss, from a grid."""
    grid = np.geomspace(0.1, 10, 61)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> LanguageModel:
    languages = sorted({label for _, label in sample})
    draw = np.random.default_rng(seed)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 0.0)
    pieces, label, held = [], [], []
    for k, (text, lang) in enumerate(sample):
        raw = text.encode()
        cuts = [raw] if k % FOLDS == 0 else [raw, *[raw[a:a + s] for a, s in zip(draw.integers(0, max(1, len(raw) - 20), 3), draw.integers(20, 200, 3))]]
        pieces += cuts
        label += [languages.index(lang)] * len(cuts)
        held += [k % FOLDS == 0 and len(sample) >= 10 * FOLDS] * len(cuts)
    label, held = np.array(label), np.array(held)
    features = []
    for p in pieces:
        buckets, n = subwords(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
        ids, counts = np.unique(buckets[buckets < BUCKETS], return_counts=True)
        features.append((ids, counts / max(1, int(n[0]))))
    embed = draw.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS))
    embed[BUCKETS] = 0
    layer, bias = draw.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))

    def pooled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(features[r][0]) for r in rows])
        ids = np.concatenate([features[r][0] for r in rows])
        share = np.concatenate([features[r][1] for r in rows])
        row = np.repeat(np.arange(len(rows)), sizes)
        out = np.zeros((len(rows), DIMENSIONS))
        np.add.at(out, row, embed[ids] * share[:, None])
        return out, ids, share, row

    training = np.flatnonzero(~held)
    for epoch in range(epochs):
        for rows in np.array_split(draw.permutation(training), max(1, len(training) // 16)):
            x, ids, share, row = pooled(rows)
            slope = softmax(x @ layer + bias)
            slope[np.arange(len(rows)), label[rows]] -= 1
            step = rate * (1 - epoch / epochs) / len(rows)
            back = slope @ layer.T
            layer -= step * x.T @ slope
            bias -= 0.1 * step * slope.sum(axis=0)
            # a bucket's share of a document is small, so its row takes a longer step
            np.add.at(embed, ids, -(20 * step) * back[row] * share[:, None])
    check = np.flatnonzero(held) if held.any() else training
    logits = pooled(check)[0] @ layer + bias
    temperature = fit_temperature(logits, label[check])
    right = softmax(logits / temperature)
    sure = right.max(axis=1)[right.argmax(axis=1) == label[check]]
    threshold = float(np.clip(np.quantile(sure, REJECT) * 0.8, 0, MOST_REJECTED)) if len(sure) else 0.0
    return LanguageModel(languages, (embed @ layer).astype(np.float32), bias, temperature, threshold)


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, most: int = MOST) -> LanguageModel:
    """Learns from (doc_id, text, lang) rows with a language whose id is not in the held-out fold."""
    rows = docs.filter(crc_slot(F.col("doc_id"), FOLDS) != 0).select("doc_id", F.col("lang").alias("label"))
    return train(labelled_sample(rows, docs.select("doc_id", "text"), per_language, most, "language"))


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score",
            accepted_col: str = "accepted") -> DataFrame:
    """The documents with the predicted language, its calibrated probability and whether that is enough to accept it."""
    docs = docs.drop(lang_col, score_col, accepted_col)
    letters = fresh("has_letter", docs.columns)
    rows = docs.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters))
    schema = StructType([*docs.schema.fields, StructField(lang_col, StringType()), StructField(score_col, DoubleType()), StructField(accepted_col, BooleanType())])

    own = docs.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            known = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            if model.languages:
                p = model.probabilities(*text_bytes(batch.column(text_col)))
                best, score = np.where(known, p.argmax(axis=1), best), np.where(known, p.max(axis=1), 0.0)
            accepted = (best < len(names) - 1) & (score >= model.threshold)
            columns = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(accepted)], schema.names)

    return rows.mapInArrow(label, schema)


def held_out(doc_id: Column) -> Column:
    return crc_slot(doc_id, FOLDS) == 0
