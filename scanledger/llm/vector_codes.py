"""Compression of vectors to codes: one codebook for each part of a vector, searched through a trie of the distinct parts.

Components become integers, vectors are cut into equal parts, and every part position has a codebook whose entries start as that part of the vectors
with the smallest ids. A round assigns every part to the nearest entry and replaces each entry by the mean of its parts.

The parts of a block of vectors are sorted at each position and their distinct values are the leaves of a *lexicographic trie*, one level for each
dimension of the part. Depth-first traversal carries, for a run of sibling nodes, the distances to all entries summed up over the dimensions so far; parts
with a common prefix share that sum. Leaves take the nearest entry; their components, times the number of vectors they stand for, are the block's share of
the new entries. A group of equal vectors is one leaf, however large it is.

Blocks are made inside tasks, so vectors are never shuffled; a round sends entries x parts x dimensions sums per task. The driver and the
tasks hold the codebooks alone (parts x entries x dimensions numbers).

Defined results: vectors that are NULL or have a NULL, NaN or infinite component are left out. Repeated ids count as rows of their own; the first entries
are those of the smallest ids, ties by the vector, a NULL id last. With fewer vectors than entries the codebook is shorter, without any it is empty. A vector
shorter than the longest one, or not divisible by the parts, is continued by zeros. Integers are held within +-2^24, as sums of squares have to stay exact.
Other columns than those named are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from scanledger.staging import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 24
BLOCK, SIBLINGS = 1 << 14, 1 << 11


def usable(vector: Column) -> Column:
    """Whether a vector has finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of ``book`` for each of the distinct, sorted rows of ``parts``; the lower entry on ties."""
    n, width = parts.shape
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    # a node begins where a prefix differs from the row before
    begins = np.zeros(n, bool)
    begins[:1] = True
    levels = []
    for d in range(width):
        begins[1:] |= parts[1:, d] != parts[:-1, d]
        levels.append(np.flatnonzero(begins))

    def visit(depth: int, low: int, high: int, above: np.ndarray) -> None:
        """Leaves below the nodes low..high of a level, whose summed distances are ``above``."""
        if depth == width:
            best = np.argmin(above, axis=1)
            entry[low:high], error[low:high] = best, above[np.arange(len(best)), best]
            return
        nodes = levels[depth]
        if depth == 0:
            first, last, starts = 0, len(nodes), np.zeros(1, np.int64)
        else:  # the children of the nodes of the level above
            parents = levels[depth - 1]
            starts = parents[low:high]
            first, last = np.searchsorted(nodes, [starts[0], parents[high] if high < len(parents) else n])
        for a in range(first, last, SIBLINGS):
            b = min(a + SIBLINGS, last)
            parent = np.searchsorted(starts, nodes[a:b], "right") - 1
            visit(depth + 1, a, b, above[parent] + (parts[nodes[a:b], depth, None] - book[None, :, depth]) ** 2)

    if n and len(book):
        visit(0, 0, 1, np.zeros((1, len(book)), np.int64))
    return entry, error


def distinct_parts(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct rows, and the place of every row among them."""
    order = np.lexsort(block.T[::-1]) if block.shape[1] else np.arange(len(block))
    ordered = block[order]
    new = np.ones(len(block), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(block), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def blocks(batches: Iterator[pa.RecordBatch], width: int, parts: int, scale: float, vector_col: str = "vector") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their vectors as integers, shaped (rows, parts, width); shorter vectors are continued by zeros."""
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            some = batch.slice(a, BLOCK)
            column = some.column(vector_col)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = whole_numbers(column.flatten().to_numpy(zero_copy_only=False), scale)
            if len(sizes) and (sizes == parts * width).all():
                yield some, values.reshape(len(some), parts, width)
            else:
                out = np.zeros((len(some), parts * width), np.int64)
                row = np.repeat(np.arange(len(some)), sizes)
                out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
                yield some, out.reshape(len(some), parts, width)


def new_sums(rows: DataFrame, books: np.ndarray, scale: float) -> DataFrame:
    """(part, entry, n, sums): how many parts chose an entry and the sums of their components; one row per task and used entry, to be added up."""
    parts, entries, width = books.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for _, vectors in blocks(batches, width, parts, scale):
            for p in range(parts):
                leaves, place = distinct_parts(vectors[:, p])
                entry, _ = nearest(leaves, books[p])
                weight = np.bincount(place, minlength=len(leaves))
                np.add.at(times[p], entry, weight)
                np.add.at(sums[p], entry, leaves * weight[:, None])
        p, e = np.nonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(times[p, e], pa.int64()), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
                                         ["part", "entry", "n", "sums"])

    return rows.select("vector").mapInArrow(add_up, "part int, entry int, n bigint, sums array<bigint>")


def train_codebooks(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                    scale: float = SCALE) -> np.ndarray:
    """The codebooks after ``rounds`` rounds, as integers shaped (parts, entries, dimensions of a part)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    width = -(-(rows.agg(F.max(F.size("vector"))).first()[0] or 0) // parts)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    books = np.zeros((len(start), parts * width), np.int64)
    for e, row in enumerate(start):
        books[e, :len(row.vector)] = whole_numbers(np.array(row.vector), scale)
    books = np.ascontiguousarray(books.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if len(start) and width else 0):
        added = new_sums(rows, books, scale).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums"))
        for row in added.collect():  # parts x entries rows at most
            books[row.part, row.entry] = np.array(row.sums, np.int64) // row.n
    return books


def encode(vectors: DataFrame, books: np.ndarray, *, vector_col: str = "embedding", scale: float = SCALE, code_col: str = "code", error_col: str = "error") -> DataFrame:
    """The usable rows without their vector, with the code (an array with the entry of each part) and the squared distance to what the code stands for."""
    parts, entries, width = books.shape
    named = vectors.filter(usable(F.col(vector_col))).drop(code_col, error_col)
    own = [f for f in named.schema.fields if f.name != vector_col]
    schema = StructType([*own, *StructType.fromDDL(f"`{code_col}` array<int>, `{error_col}` bigint")])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, vectors in blocks(batches, width, parts, scale, vector_col):
            codes, errors = np.zeros((len(some), parts), np.int32), np.zeros(len(some), np.int64)
            for p in range(parts if entries else 0):
                leaves, place = distinct_parts(vectors[:, p])
                entry, error = nearest(leaves, books[p])
                codes[:, p], errors = entry[place], errors + error[place]
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*[some.column(f.name) for f in own], code, pa.array(errors)], schema.names)

    return named.mapInArrow(assign, schema)


def with_label_error(encoded: DataFrame, *, label_col: str = "label", error_col: str = "error", name: str = "label_error") -> DataFrame:
    """The rows with the error summed over those of an equal label, NULL labels together. Sums are combined in tasks before they are shuffled."""
    rows = staged(encoded)
    sums = rows.groupBy(F.col(label_col).alias("_label")).agg(F.sum(error_col).alias(name))
    return rows.drop(name).join(sums, F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")


def hex_code(code: Column) -> Column:
    """Two hex digits for each entry."""
    return F.array_join(F.transform(code, lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")


def written_out(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and place, comma-joined."""
    return ",".join(map(str, books.ravel().tolist()))
