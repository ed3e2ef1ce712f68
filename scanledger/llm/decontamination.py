"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_BYTES`` in an Arrow batch, or one longer document. Words outside the benchmark's vocabulary cannot be part of a test phrase, so the shard's text is
reduced to the runs of vocabulary words that are long enough for the shortest phrase (nothing is lost by that). Over these runs, which
are joined by separators, an FM-index is built: suffix order by prefix doubling, the last column in a wavelet matrix, and
suffix positions sampled at every 16th place and at the beginning of each run. All phrases are searched backward at once through the
ranks of the wavelet matrix, occurrences are located by walking to the nearest sample, and the words they cover are merged into runs.

The documents are not shuffled and a passage in many documents costs each shard its own occurrences. The benchmark is a stated query
set: up to ``block_bytes`` of its text go to the tasks at a time, and a larger one takes further passes over the documents, one block each.

Defined results: NULL texts have no words; an item without words has no phrase; an item with a NULL item_id marks words but is not listed;
items with equal ids count once; repeated documents are judged each; an empty benchmark marks nothing. Columns of the documents pass
through whatever their names, and a column with a result's name is replaced.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .arrays import ALNUM, LOWER, chunks, list_array, prefix_hashes, ranges, span_hashes, text_bytes, word_bounds
from .words import fresh

WINDOW = 10
SAMPLE = 16
BLOCK_BYTES, SHARD_BYTES = 32 << 20, 8 << 20
RUNS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of every word in lower case, and the number of words of each row."""
    hashes, firsts, lasts, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, _, part, offs in chunks(data, offsets):
        part = LOWER[part]
        starts, ends, n = word_bounds(part, offs, ALNUM)
        hashes.append(span_hashes(prefix_hashes(part), starts, ends))
        firsts.append(starts + offsets[i])
        lasts.append(ends + offsets[i])
        counts.append(n)
    return tuple(np.concatenate(x) for x in (hashes, firsts, lasts, counts))


class Phrases:
    """The test phrases of one block of items: every window of ``window`` words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words, _, _, counts = hashed_words(data, offsets)
        self.vocabulary = np.unique(words)
        symbols = np.searchsorted(self.vocabulary, words) + 1
        found: dict[tuple[int, ...], set[str]] = {}
        for (item, _), end, n in zip(items, np.cumsum(counts), counts):
            text = symbols[end - n:end].tolist()
            for i in range(max(1, n - window + 1) if n else 0):
                found.setdefault(tuple(text[i:i + window]), set()).update([] if item is None else [item])
        self.size = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.symbols[k, :len(p)] = p
        self.names = sorted({x for ids in found.values() for x in ids})
        place = {x: i for i, x in enumerate(self.names)}
        self.item_counts = np.array([len(ids) for ids in found.values()], np.int64)
        self.items = np.array([place[x] for ids in found.values() for x in sorted(ids)], np.int64)
        self.shortest = int(self.size.min()) if len(found) else 0


class WaveletMatrix:
    """Rank queries on a sequence of small numbers."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit) & 1
            before = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(sequence) - int(before[-1])))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        first = np.zeros_like(at)
        for bit, before, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            at = np.where(one, zeros + before[at], at - before[at])
            first = np.where(one, zeros + before[first], first - before[first])
        return at - first


class FMIndex:
    """FM-index of a text of symbols 1, 2, ... in runs that each end with a separator 0."""

    def __init__(self, text: np.ndarray, largest: int):
        n, breaks = len(text), text == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, int(breaks.sum()) - 1 + text)  # separators differ, so no run sees the next
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[:-step] = rank[step:] + 1
            key = rank * np.int64(n + largest + 2) + second
            self.order = np.argsort(key, kind="stable")
            ordered = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank.max() == n - 1 or step >= n:
                break
            step *= 2
        self.last = text[self.order - 1]
        self.wavelet = WaveletMatrix(self.last, largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])  # rows before those of a symbol
        sampled = (self.order % SAMPLE == 0) | (self.last == 0)
        self.sample_at = np.concatenate([[0], np.cumsum(sampled)])
        self.samples, self.sampled = self.order[sampled], sampled
        self.size = n
        del self.order

    def step_back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase."""
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.size, np.int64)
        for k in range(int(size.max())):
            live = np.flatnonzero((size > k) & (low < high))
            symbol = phrases[live, size[live] - 1 - k]
            low[live], high[live] = self.step_back(symbol, low[live]), self.step_back(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            known = self.sampled[rows]
            out[left[known]] = self.samples[self.sample_at[rows[known]]] + steps
            left, rows = left[~known], rows[~known]
            rows = self.step_back(self.last[rows], rows)
            steps += 1
        return out


def occurrences(words: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word number in the shard) of every occurrence of a phrase within a document."""
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(words) or not len(phrases.size):
        return nothing
    place = np.minimum(np.searchsorted(phrases.vocabulary, words), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == words
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    heads = np.cumsum(counts)[:-1]
    heads = heads[heads < len(words)]
    begins[heads] = known[heads]
    ends = known.copy()
    ends[:-1] &= ~known[1:]
    ends[heads[heads > 0] - 1] = known[heads[heads > 0] - 1]
    starts, sizes = np.flatnonzero(begins), np.flatnonzero(ends) + 1 - np.flatnonzero(begins)
    long = sizes >= phrases.shortest
    starts, sizes = starts[long], sizes[long]
    if not len(starts):
        return nothing
    word_at = ranges(starts, sizes + 1)  # a run and the place of its separator
    text = place[np.minimum(word_at, len(words) - 1)] + 1
    text[np.cumsum(sizes + 1) - 1] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.symbols, phrases.size)
    hits = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(hits)), hits), word_at[index.locate(ranges(low, hits))]


def _marked(batch: pa.RecordBatch, text_col: str, runs_col: str, items_col: str, words_col: str, phrases: Phrases) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(text_col))
    words, _, _, counts = hashed_words(data, offsets)
    phrase, at = occurrences(words, counts, phrases)
    base = np.concatenate([[0], np.cumsum(counts)])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + phrases.size[phrase], -1)
    earlier = batch.column(runs_col) if runs_col in batch.schema.names else None
    if earlier is not None:  # of the blocks before this one
        row = np.repeat(np.arange(len(counts)), np.diff(earlier.offsets.to_numpy()))
        runs = earlier.flatten()
        np.add.at(edge, base[row] + runs.field("first").to_numpy(), 1)
        np.add.at(edge, base[row] + runs.field("last").to_numpy(), -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc_of = np.repeat(np.arange(len(counts)), counts)
    begins, ends = hit.copy(), hit.copy()
    same = doc_of[1:] == doc_of[:-1]
    begins[1:] &= ~(hit[:-1] & same)
    ends[:-1] &= ~(hit[1:] & same)
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    run_rows = doc_of[first] if len(first) else np.empty(0, np.int64)
    runs = list_array(pa.StructArray.from_arrays([pa.array((x - base[run_rows]).astype(np.int32)) for x in (first, last)], ["first", "last"]),
                      np.bincount(run_rows, minlength=len(counts)))
    n_items = phrases.item_counts[phrase]
    rows = np.repeat(doc_of[at] if len(at) else at, n_items)
    ids = phrases.items[ranges((np.cumsum(phrases.item_counts) - phrases.item_counts)[phrase], n_items)] if len(phrase) else rows
    pairs = np.unique(rows * np.int64(max(1, len(phrases.names))) + ids)
    rows, ids = np.divmod(pairs, max(1, len(phrases.names)))
    names = pa.array([phrases.names[i] for i in ids.tolist()], pa.string())
    items = list_array(names, np.bincount(rows, minlength=len(counts)))
    if earlier is not None:
        items = pa.array([sorted({*a, *b}) for a, b in zip(batch.column(items_col).to_pylist(), items.to_pylist())], items.type)
    kept = [c for c in batch.schema.names if c not in (runs_col, items_col, words_col)]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(counts.astype(np.int64)), runs, items], [*kept, words_col, runs_col, items_col])


def mark_passages(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, words_col: str = "n_words", runs_col: str = "runs", items_col: str = "items",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their number of words, the runs of words (first, last exclusive) that are in a test phrase, and the ids of
    the items whose phrases occur."""
    docs, mark, schema = _last_block(docs, benchmark, text_col, item_col, item_text_col, window, words_col, runs_col, items_col, block_bytes)
    return docs.mapInArrow(mark, schema)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _last_block(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, words_col: str, runs_col: str,
                items_col: str, block_bytes: int) -> tuple[DataFrame, Step, StructType]:
    """The documents marked by all blocks of the benchmark but the last, the function that marks the last one, and the schema it gives."""
    new = [StructField(words_col, LongType()), StructField(runs_col, RUNS), StructField(items_col, ArrayType(StringType()))]
    out = docs.select(*[f"`{c}`" for c in docs.columns if c not in (words_col, runs_col, items_col)])
    schema = StructType([*out.schema.fields, *new])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        phrases = Phrases([tuple(r) for r in rows.toLocalIterator()], window)

        def mark(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j, _, _ in chunks(*text_bytes(batch.column(text_col)), SHARD_BYTES):
                    yield _marked(batch.slice(i, j - i), text_col, runs_col, items_col, words_col, phrases)

        if block < blocks - 1:
            out = out.mapInArrow(mark, schema)
    return out, mark, schema


def cut_passages(marked: DataFrame, columns: list[str], text_col: str = "text", runs_col: str = "runs", length_col: str | None = "n_chars") -> DataFrame:
    """The documents without the words in ``runs``: each run is cut from its first to its last byte; untouched texts stay as they are.

    A document of which no word is left is dropped. ``length_col`` is set to the number of characters where a text changes.
    """
    return marked.mapInArrow(_cutter(columns, text_col, runs_col, length_col), StructType([marked.schema[c] for c in columns]))


def _cutter(columns: list[str], text_col: str, runs_col: str, length_col: str | None) -> Step:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            touched = [i for i, r in enumerate(batch.column(runs_col).to_pylist()) if r]
            texts, keep = {}, np.ones(len(batch), bool)
            for i in touched:
                raw = np.frombuffer(batch.column(text_col)[i].as_py().encode(), np.uint8)
                _, first, last, _ = hashed_words(raw, np.array([0, len(raw)]))
                runs = batch.column(runs_col)[i].as_py()
                keep[i] = sum(r["last"] - r["first"] for r in runs) < len(first)
                at, pieces = 0, []
                for r in runs:
                    pieces.append(raw[at:first[r["first"]]].tobytes())
                    at = last[r["last"] - 1]
                texts[i] = b"".join([*pieces, raw[at:].tobytes()]).decode()
            arrays = []
            for c in columns:
                column = batch.column(c)
                if touched and c in (text_col, length_col):
                    values = column.to_pylist()
                    for i in touched:
                        values[i] = texts[i] if c == text_col else len(texts[i])
                    column = pa.array(values, column.type)
                arrays.append(column)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep))

    return cut


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, length_col: str | None = "n_chars", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the passages of the benchmark; see ``mark_passages`` and ``cut_passages``.

    The last block is marked and cut in one step, so that a task has one Python worker and not one for each, and a marked text is not sent on.
    """
    words_col, runs_col, items_col = (fresh(c, docs.columns) for c in ("words_col", "runs_col", "items_col"))
    marked, mark, schema = _last_block(docs, benchmark, text_col, item_col, item_text_col, window, words_col, runs_col, items_col, block_bytes)
    cut = _cutter(docs.columns, text_col, runs_col, length_col)
    return marked.mapInArrow(lambda batches: cut(mark(batches)), StructType([schema[c] for c in docs.columns]))
