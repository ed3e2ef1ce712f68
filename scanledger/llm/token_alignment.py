"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

A text is encoded by a byte-level BPE (A, with a blank before the text) and by a BPE of pieces with byte fallback (B, which adds the blank itself). Both
cover the same bytes, so the arrays of byte offsets where their tokens end are compared by *diagonal run skipping*: at the current shift between
the indexes of both arrays, exponential probing finds how long the ends agree, and that stretch of one-to-one tokens is jumped.
What follows is an irregular group: a walk by the next smaller end goes to the next common end, notes each overlapping pair of tokens, and
gives the new shift. Texts of a batch are one stream of ends, as the end of every text is common.

How often a pair of ids is linked is counted over the corpus in documents. Documents are packed into *shelves* of some megabytes of text. A shelf keeps
its distinct pairs once, and for each document their places and how often they occur; Spark counts the shelves' pairs, finds the highest
count of every A id, and joins the answers back, shelf by shelf. So each shelf costs one row for each distinct pair in it, a pair that is in a third
of all documents included, and texts are encoded once and never shuffled.

Defined results: texts that are NULL or empty, or whose tokens of A or B do not give back a blank and the text (U+2581 becomes a blank in B), have no tokens:
all numbers are 0, arrays and the text of groups are empty. Repeated rows count as documents of their own. Ids pass through as they are; other
columns are ignored. A very long text is a shelf of its own.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from scanledger.staging import staged

from .slabs import pack, unpack

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SHELF_BYTES, CHUNK_CHARS = 8 << 20, 1 << 20
# fixed values: how a byte-level BPE splits a text before its merges, and bytes that stand for themselves in its vocabulary
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
#: Texts for the reference encoder of the vocabulary: characters whose class depends on the Unicode version, and long blanks.
RARE = regex.compile(r"[^\x20-\x7e\n\r\t¡-ɏ]|\s{256}")


class Coders(NamedTuple):
    """Both encoders, and the bytes of every token."""
    fast: object      # A for common characters
    exact: object     # A for all others
    pieces: object    # B
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_size: np.ndarray
    b_size: np.ndarray

    def a_ids(self, text: str) -> list[int]:
        if RARE.search(text):
            return self.exact.encode(" " + text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(" " + text)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each text; none where the bytes differ from the text's."""
        a = [self.a_ids(t) if t else [] for t in texts]
        b = self.pieces.encode([t or "" for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            whole = (" " + t).encode() if t else b""
            if b"".join(map(self.a_bytes.__getitem__, a[k])) != whole or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                a[k], b[k] = [], []
        return a, b


@lru_cache(1)
def load(byte_level: str, pieces: str) -> Coders:
    """The encoders of the vocabulary files, once in a Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer
    byte_of, spare = {chr(b): b for b in PRINTABLE}, 256
    for b in range(256):
        if b not in PRINTABLE:
            byte_of[chr(spare)] = b
            spare += 1
    with open(byte_level, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    ranks = {bytes(byte_of[c] for c in w): i for w, i in words.items() if all(c in byte_of for c in w)}
    exact = Tokenizer.from_file(byte_level)
    exact.encode_special_tokens = True
    a_bytes = [b""] * exact.get_vocab_size()
    for w, i in ranks.items():
        a_bytes[i] = w
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
    return Coders(tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), exact, model, a_bytes, b_bytes,
                  *(np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)))


def vocabulary(pieces: str) -> int:
    """How many ids B has."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces).vocab_size()


class Walk(NamedTuple):
    """What the walk over two arrays of ends found: the one-to-one stretches and the irregular groups in between, in turn."""
    first: np.ndarray   # of each stretch: index in A, in B, and its length
    second: np.ndarray
    length: np.ndarray
    groups: np.ndarray  # rows of (first of A, first of B, first of A after, first of B after)
    link_a: np.ndarray  # overlapping tokens inside irregular groups
    link_b: np.ndarray


def walk(a: list[int], b: list[int]) -> Walk:
    """Diagonal run skipping over two increasing arrays of ends with the same last element."""
    first, second, length, groups, of_a, of_b, i, j, n = [], [], [], [], [], [], 0, 0, len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            begun, shift, step = i, j - i, 2
            i += 1
            while i < n and a[i:i + step] == b[i + shift:i + shift + step]:  # probe 2, 4, 8, ... ends at this shift
                i += step
                step += step
            while step > 1:  # halve towards the first end that differs
                step >>= 1
                if a[i:i + step] == b[i + shift:i + shift + step]:
                    i += step
            i = min(i, n)
            first.append(begun)
            second.append(j)
            length.append(i - begun)
            j = i + shift
            if i == n:
                break
            x, y = a[i], b[j]
        groups += (i, j)
        while x != y:
            of_a.append(i)
            of_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        of_a.append(i)
        of_b.append(j)
        i, j = i + 1, j + 1
        groups += (i, j)
    return Walk(*(np.array(x, np.int64) for x in (first, second, length)), np.array(groups, np.int64).reshape(-1, 4), np.array(of_a, np.int64), np.array(of_b, np.int64))


class Aligned(NamedTuple):
    """A batch of aligned texts: ids, tokens per text, the ends of groups as indexes into the ids, and links by text."""
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    n_groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def align(coders: Coders, texts: list[str | None]) -> Aligned:
    """Encodes and aligns the texts."""
    (a, n_a), (b, n_b) = map(flat, coders.encode(texts))
    met = walk(np.cumsum(coders.a_size[a]).tolist(), np.cumsum(coders.b_size[b]).tolist())
    size = met.length
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    one_a, one_b = np.repeat(met.first, size) + inside, np.repeat(met.second, size) + inside
    a_cut, b_cut = np.sort(np.concatenate([one_a + 1, met.groups[:, 2]])), np.sort(np.concatenate([one_b + 1, met.groups[:, 3]]))
    link_a, link_b = np.concatenate([one_a, met.link_a]), np.concatenate([one_b, met.link_b])
    order = np.argsort(link_a, kind="stable")
    link_a, link_b, until = link_a[order], link_b[order], np.cumsum(n_a)
    n_groups, n_links = (np.diff(np.searchsorted(places, until, side), prepend=0) for places, side in ((a_cut, "right"), (link_a, "left")))
    return Aligned(a, b, n_a, n_b, a_cut, b_cut, n_groups, link_a, link_b, n_links)


@lru_cache(4)
def written(size: int, end: str) -> np.ndarray:
    """The ids in decimal, followed by a comma, and then those followed by ``end``."""
    return np.array([f"{i}," for i in range(size)] + [f"{i}{end}" for i in range(size)], object)


def group_texts(coders: Coders, x: Aligned) -> list[str]:
    """'a1,a2|b1;a3|b2,b3' of each text: its groups with the ids of both sides."""
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[x.a_cut - 1], last_b[x.b_cut - 1] = 1, 1
    of_a, of_b = len(coders.a_bytes), len(coders.b_bytes)
    size_a, size_b = np.diff(x.a_cut, prepend=0), np.diff(x.b_cut, prepend=0)
    out = np.empty(len(x.a) + len(x.b), object)
    out[np.arange(len(x.a)) + np.repeat(x.b_cut - size_b, size_a)] = written(of_a, "|")[x.a + of_a * last_a]
    out[np.arange(len(x.b)) + np.repeat(x.a_cut, size_b)] = written(of_b, ";")[x.b + of_b * last_b]
    parts, until = out.tolist(), np.cumsum(x.n_a + x.n_b).tolist()
    return ["".join(parts[p:q])[:-1] for p, q in zip([0, *until], until)]


def token_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per document: doc_id, a_ids and b_ids (its tokens), and a_cuts and b_cuts, how many of them the groups up to each one hold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL("a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")])

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = load(byte_level, pieces)
        for batch in batches:
            for part in cut_batch(batch, CHUNK_CHARS):
                x = align(coders, part.column("text").to_pylist())
                since_a, since_b = (np.repeat(np.cumsum(n) - n, x.n_groups) for n in (x.n_a, x.n_b))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists(x.a, x.n_a), lists(x.b, x.n_b), lists(x.a_cut - since_a, x.n_groups),
                                                  lists(x.b_cut - since_b, x.n_groups)], schema.names)

    return rows.mapInArrow(of_batch, schema)


def cut_batch(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes, or one row."""
    length = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = length[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(length, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def shelves(docs: DataFrame, coders: tuple[str, str], shelf_bytes: int) -> DataFrame:
    """One row per shelf: its documents' ids and numbers, its distinct pairs (``pairs``, with ``held``, in how many of its documents),
    and ``body``, the places of each document's pairs and how often each occurs. A pair is a number: the A id times the size of B's vocabulary, and the B id."""
    id_field = docs.schema["doc_id"]
    schema = StructType([*StructType.fromDDL("shelf bigint"), StructField("ids", ArrayType(id_field.dataType)),
                         *StructType.fromDDL("n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digests array<string>, pairs array<bigint>, "
                                             "held array<bigint>, body binary")])

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = load(*coders), (TaskContext.get().partitionId() << 32) - 1
        ids, parts, size = [], [], 0

        def full() -> pa.RecordBatch:
            n = [np.concatenate(x) for x in zip(*(p[:4] for p in parts))]
            digests = [d for p in parts for d in p[4]]
            pairs, place = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
            times, sizes = np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts])
            held = np.bincount(place, minlength=len(pairs))
            body = pack(place.astype(np.uint32), times.astype(np.uint32), sizes.astype(np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(pa.concat_arrays(ids)), *[one(pa.array(x, pa.int64())) for x in n], one(pa.array(digests, pa.string())),
                                               one(pa.array(pairs, pa.int64())), one(pa.array(held, pa.int64())), pa.array([body], pa.binary())], schema.names)

        for batch in batches:
            for part in cut_batch(batch, CHUNK_CHARS):
                x = align(both, part.column("text").to_pylist())
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(both, x)]
                # the distinct pairs of each document, in order of the document and the pair
                most = len(both.a_bytes) * len(both.b_bytes)
                keyed, times = np.unique(np.repeat(np.arange(len(part)), x.n_links) * most + x.a[x.link_a] * len(both.b_bytes) + x.b[x.link_b], return_counts=True)
                doc, pair = np.divmod(keyed, most)
                ids.append(part.column("doc_id"))
                parts.append((x.n_a, x.n_b, x.n_groups, x.n_links, digests, pair, times, np.bincount(doc, minlength=len(part))))
                size += part.column("text").nbytes
                if size >= shelf_bytes:
                    number += 1
                    yield full()
                    ids, parts, size = [], [], 0
        if ids:
            number += 1
            yield full()

    return docs.mapInArrow(gather, schema)


def link_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", byte_level: str = BYTE_LEVEL, pieces: str = PIECES,
                    shelf_bytes: int = SHELF_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many documents as any of its A id), count_sum (documents that
    hold the pair, over the links) and groups_sha256 (of ``group_texts``)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = staged(shelves(rows, (byte_level, pieces), shelf_bytes))
    asked = made.select("shelf", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("shelf", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = asked.groupBy("pair").agg(F.sum("held").alias("n")).withColumn("a", F.expr(f"pair div {vocabulary(pieces)}"))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = asked.select("shelf", "pair").join(judged, "pair").groupBy("shelf").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("told"))
    kept = made.drop("pairs", "held").join(told.select("shelf", F.col("told.n").alias("n"), F.col("told.best").alias("best")), "shelf", "left")
    schema = StructType([rows.schema.fields[0], *StructType.fromDDL("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                of = lambda c: batch.column(c)[k].values
                place, times, sizes = unpack(batch.column("body")[k].as_py())
                n, best = (np.asarray(of(c).to_numpy(zero_copy_only=False)) if batch.column(c)[k].is_valid else np.empty(0, np.int64) for c in ("n", "best"))
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])])
                times = times.astype(np.int64)
                totals = [sums(times * x.astype(np.int64)[place]) if len(x) else np.zeros(len(sizes), np.int64) for x in (best, n)]
                yield pa.RecordBatch.from_arrays([of("ids"), *[of(c) for c in ("n_a", "n_b", "n_groups", "n_links")], *[pa.array(t, pa.int64()) for t in totals], of("digests")], schema.names)

    return kept.select("shelf", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "body", "n", "best").mapInArrow(settle, schema)
