"""Slabs: runs of documents that ask all other documents something in one compact exchange.

Some operators need, for every few bytes of every text, a number that depends on the whole corpus (how often a word pair occurs,
which document has a passage first). A row for each would be many times the corpus. Here documents are packed into slabs of some
megabytes; a slab sends each *bucket* of the key space one binary array of its distinct keys (equal keys of a slab are combined before
anything is shuffled), the bucket answers each slab with one array in the same order, and the slab finds its answers by computing its
keys again. A key that is in a third of all documents costs a bucket one entry per slab.

The slabs are a table bucketed by slab number in the shared folder, so that answers are shuffled to the texts and never the texts to
the answers. Raise ``slab_bytes`` with the corpus (64 MB at 100 TB), as the number of arrays is slabs times buckets.
"""
from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from scanledger.staging import shared_folder

SLAB_BYTES = 4 << 20
MESSAGE = "bucket int, slab bigint, body binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the n-th bytes of all elements together, compressed."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
        out += [struct.pack("<2sII", a.dtype.str[1:].encode(), len(a), len(body)), body]
    return b"".join(out)


def unpack(raw: bytes) -> list[np.ndarray]:
    (count,), at, out = struct.unpack_from("<H", raw), 2, []
    for _ in range(count):
        kind, n, size = struct.unpack_from("<2sII", raw, at)
        at += 10
        dtype = np.dtype(kind.decode())
        planes = pa.decompress(raw[at:at + size], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel() if n else np.empty(0, dtype))
        at += size
    return out


def make_slabs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(slab, ids, texts): the documents in slabs of about ``slab_bytes`` of text, written once. ids are BIGINT, NULL texts ''."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def full() -> pa.RecordBatch:
            one = lambda x, kind: pa.array([pa.concat_arrays(x).to_pylist()], pa.list_(kind))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | done]), one(ids, pa.int64()), one(texts, pa.string())], ["slab", "ids", "texts"])

        for batch in batches:
            at, length = 0, np.cumsum(pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < len(batch):
                before = length[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(length, before + slab_bytes - size, "right")))
                ids.append(batch.column("id")[at:to])
                texts.append(batch.column("text")[at:to])
                size, at = size + int(length[to - 1] - before), to
                if size >= slab_bytes or to < len(batch):
                    yield full()
                    done, ids, texts, size = done + 1, [], [], 0
        if ids:
            yield full()

    made = rows.mapInArrow(gather, "slab bigint, ids array<bigint>, texts array<string>")
    name = f"slabs_{uuid.uuid4().hex}"
    (made.write.bucketBy(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "slab").option("compression", "zstd")
     .option("path", f"{shared_folder(spark).rstrip('/')}/{name}").saveAsTable(name))
    return spark.table(name)


def bucket_count(slabs: DataFrame) -> int:
    """Buckets of the key space: one for every two slabs."""
    return max(4, slabs.count() // 2)


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of sorted 64-bit keys begins, and the end: buckets are even ranges of keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def messages(slab: int, parts: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    """Rows for the buckets."""
    parts = list(parts)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([slab] * len(parts), pa.int64()),
                                       pa.array([x for _, x in parts], pa.binary())], ["bucket", "slab", "body"])


def ask(slabs: DataFrame, question: Callable[[int, pa.Array, pa.Array, dict], Iterator[tuple[int, bytes]]], extra: list[str] = ()) -> DataFrame:
    """Messages of every slab: ``question(slab, ids, texts, answers)`` yields (bucket, body); answers come from ``with_answers``."""
    extra = list(extra)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, ids, texts, answers in each_slab(batches, extra):
            yield messages(slab, question(slab, ids, texts, answers))

    return slabs.mapInArrow(send, MESSAGE)


def each_slab(batches: Iterator[pa.RecordBatch], extra: list[str] = ()) -> Iterator[tuple[int, pa.Array, pa.Array, dict[str, dict[int, bytes]]]]:
    for batch in batches:
        for i in range(len(batch)):
            answers = {c: {a["bucket"]: a["body"] for a in batch.column(c)[i].as_py() or []} for c in extra}
            yield batch.column("slab")[i].as_py(), batch.column("ids")[i].values, batch.column("texts")[i].values, answers


def answer(asked: DataFrame, reply: Callable[[list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Messages back: ``reply(slabs, bodies)`` has all messages to one bucket and yields (slab, body)."""

    def settle(group: pa.Table) -> pa.Table:
        out = list(reply(group.column("slab").to_pylist(), group.column("body").to_pylist()))
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "slab": pa.array([s for s, _ in out], pa.int64()),
                         "body": pa.array([b for _, b in out], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(settle, MESSAGE)


def with_answers(slabs: DataFrame, **answers: DataFrame) -> DataFrame:
    """The slabs with the messages to each: one row per bucket and slab at most, so a slab's list is as long as there are buckets."""
    for name, messages_back in answers.items():
        mine = messages_back.groupBy("slab").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
        slabs = slabs.join(mine, "slab", "left")
    return slabs
