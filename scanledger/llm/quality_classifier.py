"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

A text is cut into runs of letters, digits and other marks. The *type* of a token is the first ``TYPE_BITS`` bits of its hash, so every token has
one and there is no vocabulary to cut. Every type has a sparse random index vector of +1 and -1 that follows from its number. Its context is the
sum of the index vectors of the tokens up to ``NEIGHBOURS`` places away, over all documents: whole numbers, added up inside each task and then by
Spark, so that the sums do not depend on the order of rows. A word vector is the type's own index vector plus half the direction of its context,
after the part that all types share is taken off; a type without context has its index vector alone. A token also brings the vector of its *shape* (kind, capitals,
length), and a token that repeats the one before it (or a word the one before a mark) has a type and a shape of its own.
The mean vector of a document goes through a hidden layer and a logistic output, trained in numpy; the probability is divided by a temperature
fitted on documents kept out of the training.

Only the network is fitted on a bounded sample of labelled documents (``PER_LABEL`` per label): their mean vectors are made in tasks from whole
texts, and those vectors alone reach the driver, as do the sums of the 2 ** ``TYPE_BITS`` types. The scores cover the whole of every text, in Spark
tasks. The first layer is multiplied into the vector tables beforehand, which gives the same numbers.

Defined results: NULL and empty texts have the score of a zero vector; without labelled documents every score is 0.5; repeated rows get the
same score; of different texts under one labelled id the one with the least md5 is learned from; other columns pass through and are never read,
but one with the result's name is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .arrays import LOWER, chunks, list_array, mixed, prefix_hashes, span_hashes, text_bytes
from .sampling import chosen_ids
from .words import crc_slot

DIMENSIONS, NONZERO, HIDDEN, NEIGHBOURS = 64, 6, 24, 2
TYPE_BITS, PER_LABEL = 16, 1_500
SLICE = 1 << 16
FOLDS = 5

LETTER, DIGIT, MARK = 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = KIND[128:] = LETTER
IS_UPPER, IS_LOWER = np.zeros(256, np.int8), np.zeros(256, np.int8)
IS_UPPER[65:91], IS_LOWER[97:123] = 1, 1

SHAPES = 3 * 3 * 6  # kind, capitals, length
REPEAT = SHAPES
TYPES = 1 << TYPE_BITS  # the number of the type that all repeats share


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape) of every token and the number of tokens of each row. Shape REPEAT marks a copy of the token before it."""
    kind = KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets[(offsets > 0) & (offsets < len(data))]] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), counts
    hashes = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    upper, lower = (np.concatenate([[0], np.cumsum(t[data])]) for t in (IS_UPPER, IS_LOWER))
    n_upper, n_lower = upper[ends] - upper[starts], lower[ends] - lower[starts]
    capitals = np.where(n_upper == 0, 0, np.where((n_lower == 0) & (ends - starts > 1), 2, 1))
    hashes = np.where(capitals == 2, mixed(hashes), hashes)  # words in capitals are types of their own
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 5)
    shape = ((kind[starts].astype(np.int64) - 1) * 3 + capitals) * 6 + length
    row = np.repeat(np.arange(len(counts)), counts)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    letters = kind[starts] == LETTER  # the same word with a mark between
    again[2:] |= (hashes[2:] == hashes[:-2]) & (row[2:] == row[:-2]) & letters[2:]
    return hashes, np.where(again, REPEAT, shape), counts


def type_ids(hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.where(shape == REPEAT, TYPES, (hashes >> np.uint64(64 - TYPE_BITS)).astype(np.int64))


def index_vectors(numbers: np.ndarray) -> np.ndarray:
    """The sparse random vector of each number."""
    h = mixed(mixed(numbers.astype(np.uint64))[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64))
    out = np.zeros((len(numbers), DIMENSIONS))
    np.add.at(out, (np.arange(len(numbers))[:, None], (h % np.uint64(DIMENSIONS)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0))
    return out


class Contexts:
    """Occurrences and context sums of every type over the texts added so far: 34 MB, whatever their number."""

    def __init__(self) -> None:
        self.times, self.sums = np.zeros(TYPES + 1, np.int64), np.zeros((TYPES + 1, DIMENSIONS), np.int64)
        self.index = np.append(index_vectors(np.arange(TYPES + 1)), np.zeros((1, DIMENSIONS)), axis=0).astype(np.int8)  # the last is no token

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        for _, _, part, offs in chunks(data, offsets):
            hashes, shape, counts = tokens(part, offs)
            # rows without a token between documents and at both ends, so that neighbours never cross documents
            types = np.full(len(hashes) + NEIGHBOURS * (len(counts) + 1), TYPES + 1)
            types[np.arange(len(hashes)) + NEIGHBOURS * (1 + np.repeat(np.arange(len(counts)), counts))] = type_ids(hashes, shape)
            for a in range(NEIGHBOURS, len(types) - NEIGHBOURS, 4 * SLICE):
                b = min(a + 4 * SLICE, len(types) - NEIGHBOURS)
                own, n = self.index[types[a - NEIGHBOURS:b + NEIGHBOURS]], b - a
                near = np.zeros((n, DIMENSIONS), np.int8)  # no sum is beyond 2 * NEIGHBOURS * NONZERO
                for k in range(2 * NEIGHBOURS + 1):
                    if k != NEIGHBOURS:
                        near += own[k:k + n]
                order = np.argsort(types[a:b], kind="stable")
                order = order[:np.searchsorted(types[a:b][order], TYPES + 1)]
                found, first, times = np.unique(types[a:b][order], return_index=True, return_counts=True)
                if len(found):
                    self.times[found] += times
                    self.sums[found] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)


def contexts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """type, times and the context sums c0, c1, ... of every type that occurs; each task sends a row for each of its types."""
    names = [f"c{k}" for k in range(DIMENSIONS)]
    schema = StructType([StructField("type", IntegerType()), *[StructField(c, LongType()) for c in ["times", *names]]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts()
        for batch in batches:
            found.add(*text_bytes(batch.column(0)))
        seen = np.flatnonzero(found.times)
        for s in range(0, len(seen), 4096):
            of = seen[s:s + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(found.times[of]), *[pa.array(c) for c in found.sums[of].T]], schema.names)

    return docs.select(text_col).mapInArrow(count, schema).groupBy("type").agg(*[F.sum(c).alias(c) for c in ["times", *names]])


def word_vectors(times: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A row for each type, from its occurrences and context sums."""
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    shared = sums.sum(axis=0) / max(1, times.sum())
    return (unit(index_vectors(np.arange(TYPES + 1))) + 0.5 * unit(sums - times[:, None] * shared)).astype(np.float32)


def shape_vectors() -> np.ndarray:
    rows = index_vectors(np.arange(TYPES + 1, TYPES + 2 + SHAPES))
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def pooled(words: np.ndarray, shapes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over the tokens of each document of their rows in both tables, 0 for none."""
    out = np.zeros((len(offsets) - 1, words.shape[1]))
    for i, j, part, offs in chunks(data, offsets):
        hashes, shape, counts = tokens(part, offs)
        types, row = type_ids(hashes, shape), np.repeat(np.arange(i, j), counts)
        for a in range(0, len(types), SLICE):  # a slice of tokens at a time: their vectors take far more room than the tokens
            rows, first = np.unique(row[a:a + SLICE], return_index=True)
            out[rows] += np.add.reduceat(words[types[a:a + SLICE]] + shapes[shape[a:a + SLICE]], first, axis=0)
        out[i:j] /= np.maximum(counts, 1)[:, None]
    return out


class QualityModel(NamedTuple):
    words: np.ndarray   # a row for each type: its vector times the first layer
    shapes: np.ndarray  # the same for each shape
    first_bias: np.ndarray
    second: np.ndarray
    bias: float
    temperature: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled(self.words, self.shapes, data, offsets) + self.first_bias, 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.second + self.bias) / self.temperature, -50, 50)))


def untrained() -> QualityModel:
    return QualityModel(np.zeros((TYPES + 1, 1), np.float32), np.zeros((SHAPES + 1, 1), np.float32), np.zeros(1), np.zeros(1), 0.0, 1.0)


def train(sample: list[tuple[str, str]]) -> QualityModel:
    """From (text, '0' or '1') alone, contexts included."""
    if not sample:
        return untrained()
    raw, found = text_bytes(pa.array([t for t, _ in sample], pa.large_string())), Contexts()
    found.add(*raw)
    vectors = word_vectors(found.times, found.sums)
    return network(vectors, pooled(vectors, shape_vectors(), *raw), np.array([float(label) for _, label in sample]))


def network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 11) -> QualityModel:
    """The model that two layers make of the word vectors, learned from mean vectors x and labels y."""
    draw = np.random.default_rng(seed)
    held = np.arange(len(y)) % FOLDS == 0 if len(y) >= 10 * FOLDS else np.zeros(len(y), bool)
    scale = np.maximum(x[~held].std(axis=0), 1e-3)
    weights = [draw.normal(0, 1 / np.sqrt(DIMENSIONS), (DIMENSIONS, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    moment, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rows = np.flatnonzero(~held)
    for _ in range(epochs):
        for batch in np.array_split(draw.permutation(rows), max(1, len(rows) // 64)):
            inputs = x[batch] / scale
            hidden = np.maximum(inputs @ weights[0] + weights[1], 0)
            slope = (1 / (1 + np.exp(-(hidden @ weights[2] + weights[3]))) - y[batch]) / len(batch)
            back = slope[:, None] * weights[2] * (hidden > 0)
            slopes = [inputs.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ slope + 1e-4 * weights[2], slope.sum(keepdims=True)]
            step += 1
            for w, m, s, g in zip(weights, moment, square, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.005 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    check = np.flatnonzero(held) if held.any() else rows
    logits = np.maximum(x[check] / scale @ weights[0] + weights[1], 0) @ weights[2] + weights[3]
    grid = np.geomspace(0.2, 10, 61)
    # smoothed targets: a perfect separation of the few rows kept out is no ground for endless confidence
    up, down = y[check].sum(), (1 - y[check]).sum()
    target = np.where(y[check] > 0, (up + 1) / (up + 2), 1 / (down + 2))
    loss = [np.mean(np.logaddexp(0, logits / t) - target * logits / t) for t in grid]
    layer = weights[0] / scale[:, None]
    return QualityModel((vectors @ layer).astype(np.float32), (shape_vectors() @ layer).astype(np.float32), weights[1], weights[2], float(weights[3][0]),
                        float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL) -> QualityModel:
    """Word vectors from every (doc_id, text); the network from those with a (doc_id, quality) whose id is not in the held-out fold."""
    rows = labels.filter(crc_slot(F.col("doc_id"), FOLDS) != 0).filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("string").alias("label"))
    chosen = chosen_ids(rows, per_label, 2 * per_label, "quality")
    if not chosen:
        return untrained()
    times, sums = np.zeros(TYPES + 1, np.int64), np.zeros((TYPES + 1, DIMENSIONS), np.int64)
    found = contexts(docs).toArrow()
    at = found.column("type").to_numpy()
    times[at] = found.column("times").to_numpy()
    for k in range(DIMENSIONS):
        sums[at, k] = found.column(f"c{k}").to_numpy()
    vectors, by_id = word_vectors(times, sums), {}
    for r in mean_vectors(docs.filter(F.col("doc_id").isin([r.doc_id for r in chosen])), vectors).collect():
        if r.doc_id not in by_id or r.digest < by_id[r.doc_id].digest:
            by_id[r.doc_id] = r
    learned = [(by_id[r.doc_id].mean, float(r.label)) for r in chosen if r.doc_id in by_id]
    return network(vectors, np.array([x for x, _ in learned]), np.array([y for _, y in learned])) if learned else untrained()


def mean_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, md5 of the text and mean vector of every document."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    schema = StructType([rows.schema["doc_id"], StructField("digest", StringType()), StructField("mean", ArrayType(DoubleType()))])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = pooled(vectors, shape_vectors(), *text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(pa.array(means.ravel()), np.full(len(means), DIMENSIONS))], schema.names)

    return rows.mapInArrow(pool, schema)


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with the calibrated probability of good quality."""
    docs = docs.drop(score_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(*text_bytes(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(rate, schema)
