"""Resumable ingest: every new chunk file exactly once, bad volumes and bad chunks set aside, bounded runs.

A file is a chunk. A stream of file names, with its checkpoint, notes every file once. Files that were not read yet are then taken in batches of many:
Spark reads them in parallel, one file in one task and row group by row group, so that a task's memory does not grow with a file, and an
unreadable file becomes an error record without rows instead of a failure of the job. A batch is
*landed* in one write, records of its files and rows of its volumes together. A second stream over the landed rows keeps the accepted volume ids as keyed
state (``dropDuplicates`` on a RocksDB store, spread over the shuffle partitions) and appends the volumes no file brought before.

So no batch reads what earlier ones wrote: names and file records are read once a run, volumes never. A run that is killed leaves a batch that is
landed or not; a landed one is accepted first thing in the next run, as a micro-batch of its own. A failed file is tried again by the next run.

Tables under the target (``read_table``):

* ``accepted``: volumes that no other file brought before; of one batch's rows, that with the least (chunk, file, position)
* ``failures``: rows that are marked as failed or have no volume
* ``outcomes``: chunk, volume, failed, cached, error of every row (``chunk_events`` makes one record per chunk of them)
* ``attempts``: chunk file, attempt, failed, error
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.hashing import hash32
from ..sources.raw import locate

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
ATTEMPT_SCHEMA = "chunk string, attempt bigint, failed boolean, error string"
#: Columns of a landed row beside those of the chunk files.
LANDED = "_file string, _position bigint, _attempt bigint, _file_error string, _first boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 64
#: Rows of a chunk file that a task holds at a time, and bytes of each of its columns.
BLOCK_ROWS = 10_000
READ_BUFFER = 1 << 20


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, *, max_chunks: int | None = None, max_streak: int = 3,
           files_per_batch: int = FILES_PER_BATCH) -> int:
    """Run until every chunk file present was tried once, ``max_chunks`` were, or ``max_streak`` failed in a row; returns the number tried.

    Rows have volume_id, chunk, failed, error and cached. Volumes already accepted are not taken again, whichever chunk brings them. Files that
    failed before come first. Files of a batch behind the last one allowed to fail are not recorded and stay for the next run.
    """
    note_names(spark, source, target, checkpoint)
    accept(spark, schema, target, checkpoint)
    tried: list[bool] = []
    batch: list = []

    def take() -> bool:
        """Lands and accepts the batch; False at the end of the run."""
        results = land(spark, [(r.path, r.attempts + 1) for r in batch], schema, target, tried, max_streak)
        batch.clear()
        tried.extend(results)
        accept(spark, schema, target, checkpoint)
        return not (len(tried) >= max_streak and not any(tried[-max_streak:]))

    for row in waiting(spark, target).toLocalIterator():
        if max_chunks is not None and len(tried) + len(batch) >= max_chunks:
            break
        batch.append(row)
        if len(batch) >= files_per_batch and not take():
            return len(tried)
    if batch:
        take()
    return len(tried)


def note_names(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Adds the names of new files; a replayed batch writes the same folder."""
    names = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.parquet").load(source).select("path")

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/names/batch={batch_id}")

    names.writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/names").trigger(availableNow=True).start().awaitTermination()


def waiting(spark: SparkSession, target: str) -> DataFrame:
    """(path, attempts): files to take, those that failed before first."""
    if not _exists(spark, f"{target}/names"):
        return spark.createDataFrame([], "path string, attempts bigint")
    names = spark.read.parquet(f"{target}/names").select("path").distinct()
    tries = attempts(spark, target).groupBy(F.col("chunk").alias("path")).agg(F.max("attempt").alias("attempts"), F.max_by("failed", "attempt").alias("failed"))
    left = names.join(tries, "path", "left").filter("attempts IS NULL OR failed")
    return left.orderBy(F.col("attempts").isNull(), "path").select("path", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def read_files(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of the files, and for each file one row without a position that has its error, if any. Columns a file lacks are NULL.

    Files are opened by name in tasks and read in blocks. A file that turns out to be broken behind its first blocks has rows and an error: its
    rows do not count (``land`` drops them). A file that is gone has no row.
    """
    fields = StructType.fromDDL(schema)
    out = StructType([*fields, *StructType.fromDDL("_file string, _position bigint, _file_error string")])
    arrow = to_arrow_schema(out)

    def blocks(where: pa.NativeFile, path: str) -> Iterator[pa.RecordBatch]:
        file, n = pq.ParquetFile(where, buffer_size=READ_BUFFER, pre_buffer=False), 0
        names = file.schema_arrow.names
        for block in file.iter_batches(batch_size=BLOCK_ROWS, columns=[f.name for f in fields if f.name in names]):
            rows = block.num_rows
            columns = [block.column(f.name).cast(arrow.field(f.name).type) if f.name in names else pa.nulls(rows, arrow.field(f.name).type) for f in fields]
            columns += [pa.array([path] * rows, pa.string()), pa.array(range(n, n + rows), pa.int64()), pa.nulls(rows, pa.string())]
            n += rows
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict = {}
        for batch in batches:
            for path in batch.column("path").to_pylist():
                error = None
                try:
                    system, name = locate(path, systems)
                    with system.open_input_file(name) as where:
                        yield from blocks(where, path)
                except FileNotFoundError:
                    continue
                except Exception as exc:  # whatever is wrong with the file is told in its record
                    error = f"{type(exc).__name__}: {exc}"[:1000]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, arrow.field(f.name).type) for f in fields], pa.array([path]), pa.nulls(1, pa.int64()), pa.array([error], pa.string())], schema=arrow)

    # each name once, in a task of its own: names are dealt by their number in the list
    names = spark.createDataFrame(list(enumerate(paths)), "n bigint, path string").repartitionByRange(len(paths), "n").select("path")
    return names.mapInArrow(each, out)


def land(spark: SparkSession, files: list[tuple[str, int]], schema: str, target: str, tried: list[bool], max_streak: int) -> list[bool]:
    """Reads the files (path, attempt) and writes what they hold and how they went in one table; whether each recorded one was read."""
    read = read_files(spark, [p for p, _ in files], schema).persist()
    try:
        errors = {r._file: r._file_error for r in read.filter("_position IS NULL").select("_file", "_file_error").collect()}
        results: list[bool] = []
        for path, _ in files:
            results.append(path in errors and errors[path] is None)
            told = [*tried, *results]
            if len(told) >= max_streak and not any(told[-max_streak:]):
                break
        kept = files[:len(results)]
        number = F.create_map(*[F.lit(x) for pair in kept for x in pair])
        whole = F.col("_position").isNull() | F.col("_file").isin([p for p, _ in kept if p in errors and errors[p] is None])
        rows = read.filter(F.col("_file").isin([p for p, _ in kept]) & whole).withColumn("_attempt", number[F.col("_file")].cast("bigint"))
        best = rows.filter(~bad_row() & F.col("_position").isNotNull()).groupBy(F.col("volume_id").alias("_v")).agg(F.min(F.struct("chunk", "_file", "_position")).alias("_best"))
        first = F.coalesce((F.col("_best._file") == F.col("_file")) & (F.col("_best._position") == F.col("_position")), F.lit(False))
        landed = rows.join(best, F.col("volume_id") == F.col("_v"), "left").withColumn("_first", first).drop("_v", "_best")
        landed = landed.withColumn("_kind", F.when(F.col("_position").isNull(), "file").otherwise("row"))
        missing = [(p, n) for p, n in kept if p not in errors]  # a file that went away between its listing and its reading
        if missing:
            gone = spark.createDataFrame(missing, "_file string, _attempt bigint").withColumn("_file_error", F.lit("the file is gone")).withColumn("_kind", F.lit("file"))
            landed = landed.unionByName(gone, allowMissingColumns=True)
        name = hashlib.md5(repr(kept).encode()).hexdigest()
        landed.write.mode("overwrite").partitionBy("_kind").parquet(f"{target}/landed/batch=b_{name}")
    finally:
        read.unpersist()
    return results


def bad_row():
    return F.coalesce(F.col("failed") | F.col("volume_id").isNull(), F.lit(True))


def accept(spark: SparkSession, schema: str, target: str, checkpoint: str) -> None:
    """Appends the volumes of landed rows that no file brought before. The accepted ids are state of the stream."""
    if not _exists(spark, f"{target}/landed"):
        return
    fields = StructType.fromDDL(schema)
    whole = StructType([*fields, *StructType.fromDDL(f"{LANDED}, batch string, _kind string")])
    rows = spark.readStream.schema(whole).parquet(f"{target}/landed").filter((F.col("_kind") == "row") & F.col("_first") & ~bad_row())
    fresh = rows.select(*fields.names).dropDuplicates(["volume_id"])
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        fresh.writeStream.format("parquet").option("path", f"{target}/accepted").option("checkpointLocation", f"{checkpoint}/accepted").trigger(
            availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def attempts(spark: SparkSession, target: str) -> DataFrame:
    """One row for each try of a chunk file: chunk, attempt, failed, error."""
    if not _exists(spark, f"{target}/landed"):
        return spark.createDataFrame([], ATTEMPT_SCHEMA)
    landed = spark.read.parquet(f"{target}/landed").filter("_kind = 'file'")
    return landed.select(F.col("_file").alias("chunk"), F.col("_attempt").alias("attempt"), F.col("_file_error").isNotNull().alias("failed"), F.col("_file_error").alias("error"))


def failed_chunks(spark: SparkSession, target: str) -> DataFrame:
    """Chunk files whose last attempt failed, with their failed attempts since the last success."""
    return failed_attempts(attempts(spark, target).select("chunk", "attempt", "failed")).orderBy("chunk")


def chunk_events(spark: SparkSession, target: str) -> DataFrame:
    """One record per chunk id, whichever files its volumes came in."""
    return chunk_records(read_table(spark, target, "outcomes"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """One of the tables of the module's description."""
    if name == "attempts":
        return attempts(spark, target)
    if name == "accepted":
        return spark.read.option("mergeSchema", True).parquet(f"{target}/accepted")
    rows = spark.read.option("mergeSchema", True).parquet(f"{target}/landed").filter("_kind = 'row'")
    own = [c for c in rows.columns if not c.startswith("_") and c != "batch"]
    return {"failures": rows.filter(bad_row()).select(*own), "outcomes": rows.select("chunk", "volume_id", bad_row().alias("failed"), "cached", "error")}[name]


def volume_outcomes(log: DataFrame) -> DataFrame:
    """One row per (chunk, volume): failed, cached, error."""
    failed = F.coalesce(F.col("failed"), F.lit(False))
    cached = F.coalesce(F.col("cached"), F.lit(False)) if "cached" in log.columns else F.lit(False)
    return log.groupBy("chunk", "volume_id").agg(F.bool_or(failed).alias("f"), F.bool_or(cached).alias("c"), F.min("error").alias("error"))


def chunk_records(log: DataFrame) -> DataFrame:
    """Per chunk: volumes, ok, cached and failed. The failures themselves stay rows (``failure_list``)."""
    return volume_outcomes(log).groupBy("chunk").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_volumes"), F.count_if(~F.col("f") & ~F.col("c")).cast("bigint").alias("n_ok"),
        F.count_if(~F.col("f") & F.col("c")).cast("bigint").alias("n_cached"), F.count_if("f").cast("bigint").alias("n_failed"))


def failure_list(log: DataFrame) -> DataFrame:
    """One row per failed volume of a chunk."""
    return volume_outcomes(log).filter("f").select("chunk", "volume_id", F.coalesce("error", F.lit("unknown error")).alias("error"))


def failed_maps(log: DataFrame, per_map: int = 1000) -> DataFrame:
    """``failed`` as MAP<volume, error> for the record form: (chunk, part, n_failed of the chunk, failed).

    A chunk has one map for about every ``per_map`` failures, split by a hash of the volume, so that no row grows with a chunk and no failure is
    left out.
    """
    failures = failure_list(log)
    sizes = failures.groupBy("chunk").agg(F.count(F.lit(1)).cast("bigint").alias("n_failed"))
    part = F.pmod(hash32(F.col("volume_id")), F.ceil(F.col("n_failed") / per_map)).alias("part")
    return failures.join(sizes, "chunk").select("chunk", part, "n_failed", "volume_id", "error").groupBy("chunk", "part", "n_failed").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("volume_id", "error")))).alias("failed"))


def failed_attempts(log: DataFrame) -> DataFrame:
    """Failed attempts per chunk since its last success, from the attempt log (chunk, attempt, failed); chunks without any are left out."""
    last = F.max(F.when(~F.col("failed"), F.col("attempt")))
    per = log.groupBy("chunk", "attempt").agg(F.count_if("failed").alias("n"), F.bool_or(~F.col("failed")).alias("ok"))
    done = log.groupBy("chunk").agg(last.alias("done"))
    return per.join(done, "chunk").filter(F.col("done").isNull() | (F.col("attempt") > F.col("done"))).groupBy("chunk").agg(
        F.sum("n").cast("bigint").alias("attempts")).filter("attempts > 0")


def retry_set(records: DataFrame, planned: DataFrame) -> DataFrame:
    """Chunks to process: never finished, or finished with failures."""
    clean = records.filter("n_failed = 0").select("chunk")
    return planned.select("chunk").distinct().join(clean, "chunk", "left_anti")


def all_failed(records: DataFrame) -> DataFrame:
    """Chunks whose every needed volume failed: the chunk itself failed (network, login)."""
    return records.filter((F.col("n_failed") > 0) & (F.col("n_failed") == F.col("n_volumes") - F.col("n_cached"))).select("chunk", "n_failed")


def status_report(records: DataFrame, planned: DataFrame, sizes_mb: DataFrame) -> DataFrame:
    """One row: chunks done of planned, chunks with failures, volumes ok and failed, MB per volume and projected GB."""
    total = planned.select("chunk").distinct().agg(F.count(F.lit(1))).scalar()
    mb = sizes_mb.agg(F.sum("mb")).scalar()
    sums = records.agg(F.count(F.lit(1)).cast("bigint").alias("chunks_done"), F.count_if(F.col("n_failed") > 0).cast("bigint").alias("chunks_with_failures"),
                       F.sum(F.col("n_ok") + F.col("n_cached")).cast("bigint").alias("volumes_ok"), F.sum("n_failed").cast("bigint").alias("volumes_failed"),
                       F.sum("n_volumes").cast("bigint").alias("volumes"))
    per = F.col("mb_total") / F.greatest(F.col("volumes_ok"), F.lit(1))
    return sums.withColumn("chunks_planned", total.cast("bigint")).withColumn("mb_total", mb).withColumn("mb_per_volume", per).withColumn(
        "projected_gb", F.col("mb_per_volume") * (F.col("volumes") / F.col("chunks_done")) * F.col("chunks_planned") / 1000).drop("volumes", "mb_total")


def first_failures(log: DataFrame, n: int = 5) -> DataFrame:
    """The first n failed volumes in chunk order, errors shortened for display."""
    return failure_list(log).orderBy("chunk", "volume_id").limit(n).withColumn("error", F.substring("error", 1, 120))
