"""Writers: write-once tables, growing ledgers, report bundles, validated embedding stores.

Tables and ledger batches are published by renaming a finished folder, never by writing into place. A rename to a folder
that exists fails, so of several writers one wins and a killed one leaves only a hidden folder that no reader sees. This
needs a file system whose folder renames are atomic (a local disk, HDFS); plain object stores have none.
"""
from __future__ import annotations

import os
import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..checks import CheckFailed
from .raw import hadoop

FP16_MAX = 65504.0
WRITER, BATCH = "_writer", "_batch"


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def publish(spark: SparkSession, attempt: str, path: str) -> bool:
    """Rename the finished folder ``attempt`` to ``path``; False, and ``attempt`` removed, where ``path`` is already there."""
    fs, target = hadoop(spark, path)
    source = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(attempt))
    fs.mkdirs(target.getParent())
    try:
        if target.toUri().getScheme() == "file":
            os.rename(source.toUri().getPath(), target.toUri().getPath())
        else:
            jvm = spark._jvm.org.apache.hadoop.fs
            jvm.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(
                source, target, spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0))
        return True
    except (OSError, Py4JJavaError):
        if not fs.exists(target):
            raise
    fs.delete(source, True)
    return False


def _hidden(path: str) -> str:
    """A folder beside ``path`` that readers skip."""
    head, _, name = path.rstrip("/").rpartition("/")
    return f"{head}/.{name}-{uuid.uuid4().hex}" if head else f".{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str, *partition_by: str) -> None:
    """A plan is never replaced: an existing table is an error. Of several writers at once one wins; a killed one can be run again."""
    spark = df.sparkSession
    if not _exists(spark, path):
        attempt = _hidden(path)
        df.write.partitionBy(*partition_by).parquet(attempt)
        if publish(spark, attempt, path):
            return
    raise CheckFailed(f"{path}: already written")


def _folder_name(text: str) -> str:
    """Encoded twice: readers of partition folders undo it once, byte by byte."""
    return quote(quote(text, safe=""), safe="")


def append_ledger(rows: DataFrame, path: str, batch: str, writer: str = "main") -> bool:
    """Append the rows as batch ``batch`` of ``writer``; False, and nothing changed, where that batch was appended before.

    New columns are added for all readers, none is ever removed. Batches are folders named by writer and batch, so the
    folder names are the commit log: a replay finds its own batch, and writers never touch each other's.
    """
    spark = rows.sparkSession
    clash = {WRITER, BATCH} & set(rows.columns)
    if clash or not batch or not writer:
        raise CheckFailed(f"{path}: a batch needs a name, a writer, and no column of its own called {sorted(clash) or [WRITER, BATCH]}")
    target = f"{path.rstrip('/')}/{WRITER}=w.{_folder_name(writer)}/{BATCH}=b.{_folder_name(batch)}"
    if _exists(spark, target):
        return False
    attempt = f"{path.rstrip('/')}/.attempt-{uuid.uuid4().hex}"
    rows.write.parquet(attempt)
    return publish(spark, attempt, target)


def committed(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    """(writer, batch) of every batch in the ledger; a listing of folders."""
    fs, root = hadoop(spark, path.rstrip("/"))
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"{WRITER}=*/{BATCH}=*")) or []
    names = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found]
    return {(unquote(unquote(w[len(WRITER) + 3:])), unquote(unquote(b[len(BATCH) + 3:]))) for w, b in names}


def read_ledger(spark: SparkSession, path: str, provenance: bool = False) -> DataFrame:
    """All rows of all batches; ``provenance`` adds the columns ``_writer`` and ``_batch``."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if not provenance:
        return df.drop(WRITER, BATCH)
    names = (WRITER, BATCH)
    return df.select(*[c for c in df.columns if c not in names], *[F.url_decode(F.substr(F.col(c), F.lit(3))).alias(c) for c in names])


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """The named tables of one report; an earlier bundle is replaced, since reports are derived."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def validate_embeddings(slices: DataFrame, dim: int, half_precision: bool = True) -> DataFrame:
    """Adds ``reason``: why a slice may not be stored, NULL when it may."""
    bad = F.exists("emb", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    reason = F.when(F.col("emb").isNull() | (F.size("emb") == 0), "empty embedding").when(F.size("emb") != dim, F.concat(
        F.lit(f"expected {dim} dimensions, got "), F.size("emb").cast("string"))).when(bad, "contains NaN or inf")
    if half_precision:
        reason = reason.when(F.exists("emb", lambda v: F.abs(v) >= FP16_MAX), "exceeds the half precision range")
    return slices.withColumn("reason", reason)


def rejected_volumes(validated: DataFrame) -> DataFrame:
    """Volumes with a bad slice and the first reason; the whole volume is refused."""
    return validated.filter("reason IS NOT NULL").groupBy("volume_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("bad_slices"), F.min("reason").alias("reason"))


def write_embeddings(validated: DataFrame, path: str) -> None:
    """Store the volumes whose slices are all valid."""
    good = validated.join(rejected_volumes(validated).select("volume_id"), "volume_id", "left_anti")
    good.drop("reason").write.mode("append").parquet(path)


def store_index(slices: DataFrame) -> DataFrame:
    return slices.groupBy("volume_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_slices"), F.max(F.size("emb")).cast("bigint").alias("embed_dim"))
