"""Language-model scoring with deleted interpolation.

A text is a sequence of words in lower case (A-Z) and one end. The probability of a token after the token before it mixes three maximum-likelihood
estimates: of the pair, of the token alone, and one over the number of types and one unknown type. The weights depend on how
often the context was seen (buckets of powers of two) and are learned by expectation-maximisation: one part of the training documents
is deleted from the counts, and the weights are those that predict its tokens best. The counts of the final model are those of all training
documents.

Every count covers the whole corpus and comes from one exchange of ``slabs``: distinct words and pairs of a slab go to the bucket of their
64-bit hash with their counts, and come back with the totals. The deleted part meets the driver only as a histogram
over (context bucket, pair estimate, word estimate), the estimates in steps of an eighth of a power of two; its size is bounded by the steps,
not by the corpus.

Defined results: NULL and blank texts are the end alone; documents with a NULL id count as the id ''; repeated rows count and are scored each; without
training documents every estimate is zero and every token has the probability of an unknown one; other columns of the input are ignored.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scanledger.staging import staged

from .arrays import LOWER, SPACED, U64, chunks, mixed, prefix_hashes, span_hashes, text_bytes, word_bounds
from .slabs import SLAB_BYTES, answer, ask, bucket_count, cut, each_slab, make_slabs, pack, unpack, with_answers

FOLDS, HELD_OUT, DELETED = 7, 2, 3
END, START = U64(0xE5D0000000000001), U64(0x57A2700000000001)  # fixed hashes of the end and of the place before the first token
STEPS = 8       # per power of two
CONTEXTS = 64   # buckets of context counts: 0, 1, 2-3, 4-7, ...
TOTALS = -1     # the slab number under which a bucket reports its totals


class Slab:
    """Tokens of a slab, its distinct tokens and pairs with their counts among training and among deleted documents."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        data, offsets = text_bytes(texts)
        hashes, counts = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for _, _, part, offs in chunks(data, offsets):
            part = LOWER[part]
            starts, ends, n = word_bounds(part, offs, SPACED)
            hashes.append(span_hashes(prefix_hashes(part), starts, ends))
            counts.append(n)
        words, n = np.concatenate(hashes), np.concatenate(counts)
        self.sizes = n + 1
        self.ends = np.cumsum(self.sizes)
        token = np.full(int(self.sizes.sum()), END, U64)
        inner = np.ones(len(token), bool)
        inner[self.ends - 1] = False
        token[inner] = words
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.ends - self.sizes] = START
        part = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids.to_pylist()], np.int64)
        self.held_out, self.deleted = part == HELD_OUT, part == DELETED
        row = np.repeat(np.arange(len(n)), self.sizes)
        pair = mixed(context * U64(0x9E3779B97F4A7C15) + token)
        self.keys, self.place, self.counts = [], [], []
        for values in (token, pair):
            keys, place = np.unique(values, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place)
            self.counts.append([np.bincount(place[flag[row]], minlength=len(keys)).astype(np.uint32) for flag in (~self.held_out, self.deleted)])
        # the place of the context among the tokens; START counts as often as END, once per document
        self.context = np.empty_like(self.place[0])
        self.context[1:] = self.place[0][:-1]
        self.context[self.ends - self.sizes] = np.searchsorted(self.keys[0], END)
        self.row = row


def _question(buckets: int):
    def question(slab, ids, texts, _):
        s = Slab(ids, texts)
        edges = [cut(k, buckets) for k in s.keys]
        for b in range(buckets):
            part = [slice(e[b], e[b + 1]) for e in edges]
            if any(p.start < p.stop for p in part):
                yield b, pack(*[x for kind in (0, 1) for x in (np.diff(s.keys[kind][part[kind]], prepend=U64(0)), *[c[part[kind]] for c in s.counts[kind]])])
    return question


def _totals(slabs: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Totals of every key of every slab; under TOTALS the types and tokens of the bucket, in training and without the deleted part."""
    parts = [unpack(b) for b in bodies]
    back = [[] for _ in parts]
    for kind in (0, 1):
        sizes = [len(p[3 * kind]) for p in parts]
        keys, place = np.unique(np.concatenate([np.cumsum(p[3 * kind], dtype=U64) for p in parts]), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([p[3 * kind + 1 + k] for p in parts]), len(keys)).astype(np.int64) for k in (0, 1)]
        if kind == 0:
            rest = sums[0] - sums[1]
            yield TOTALS, pack(np.array([(sums[0] > 0).sum(), sums[0].sum(), (rest > 0).sum(), rest.sum()], np.int64))
        for mine, end, n in zip(back, np.cumsum(sizes), sizes):
            mine += [s[place[end - n:end]] for s in sums]
    for slab, mine in zip(slabs, back):
        yield slab, pack(*mine)


class Totals(NamedTuple):
    types: int
    tokens: int
    rest_types: int
    rest_tokens: int


def _counted(s: Slab, answers: dict[int, bytes], buckets: int) -> list[np.ndarray]:
    """For every token: counts of it, of its pair and of its context, in training and in the deleted part."""
    found = [np.zeros(len(s.keys[k // 2]), np.int64) for k in range(4)]
    edges = [cut(k, buckets) for k in s.keys]
    for b, body in answers.items():
        for k, x in enumerate(unpack(body)):
            found[k][edges[k // 2][b]:edges[k // 2][b + 1]] = x
    return [found[0][s.place[0]], found[2][s.place[1]], found[0][s.context], found[1][s.place[0]], found[3][s.place[1]], found[1][s.context]]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def _step(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else 1 + its place on the scale of steps."""
    return np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * STEPS).astype(np.int64) + 1, 0)


def learn_weights(histogram: np.ndarray, types: int, rounds: int = 40) -> np.ndarray:
    """(CONTEXTS, 3) weights of pair, word and unknown from rows (context bucket, pair step, word step, tokens)."""
    bucket, pair, word, n = histogram.T
    scale = lambda step: np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)
    p = np.stack([scale(pair), scale(word), np.full(len(n), 1 / (types + 1))], axis=1)
    start = np.full((CONTEXTS, 3), 1 / 3)
    start[0] = 0, 0.5, 0.5  # a context that was never seen has no pairs
    weights = start.copy()
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = start.copy()  # one token's worth of the starting weights keeps every estimate in the mix
        np.add.at(sums, bucket, share)
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def mixed_probability(word: np.ndarray, pair: np.ndarray, context: np.ndarray, weights: np.ndarray, types: int, tokens: int) -> np.ndarray:
    w = weights[context_bucket(context)]
    return w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)


class Scorer(NamedTuple):
    """A fitted model: the slabs with the counts each needs, the totals, and the weights."""
    slabs: DataFrame
    buckets: int
    totals: Totals
    weights: np.ndarray


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slab_bytes: int = SLAB_BYTES) -> Scorer:
    slabs = make_slabs(docs, id_col, text_col, slab_bytes)
    buckets = bucket_count(slabs)
    counts = staged(answer(ask(slabs, _question(buckets)), _totals))
    told = [unpack(bytes(r.body))[0] for r in counts.filter(F.col("slab") == TOTALS).select("body").toLocalIterator()]
    totals = Totals(*(int(x) for x in np.sum(told, axis=0))) if told else Totals(0, 0, 0, 0)
    known = with_answers(slabs, counts=counts.filter(F.col("slab") != TOTALS))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in each_slab(batches, ["counts"]):
            s = Slab(ids, texts)
            of = s.deleted[s.row]
            word, pair, context, less_word, less_pair, less_context = (x[of] for x in _counted(s, answers["counts"], buckets))
            word, pair, context = word - less_word, pair - less_pair, context - less_context
            cells = np.stack([context_bucket(context), _step(pair / np.maximum(context, 1)), _step(word / max(totals.rest_tokens, 1))], axis=1)
            cells, n = np.unique(cells, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cells.T], pa.array(n)], ["bucket", "pair", "word", "n"])

    rows = known.mapInArrow(describe, "bucket bigint, pair bigint, word bigint, n bigint").groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
    histogram = np.array([tuple(r) for r in rows.collect()], np.int64).reshape(-1, 4)
    return Scorer(known, buckets, totals, learn_weights(histogram[np.lexsort(histogram.T[::-1])], totals.rest_types))


def score(model: Scorer) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10."""
    _, buckets, totals, weights = model

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in each_slab(batches, ["counts"]):
            s = Slab(ids, texts)
            word, pair, context = _counted(s, answers["counts"], buckets)[:3]
            first = s.ends - s.sizes
            base = np.add.reduceat(np.log10((word + 1) / (totals.tokens + totals.types + 1)), first)
            model_score = np.add.reduceat(np.log10(mixed_probability(word, pair, context, weights, totals.types, totals.tokens)), first)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(s.held_out), pa.array(s.sizes.astype(np.int64)), pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                 pa.array(np.full(len(ids), totals.tokens)), pa.array(base), pa.array(model_score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return model.slabs.mapInArrow(
        rate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
