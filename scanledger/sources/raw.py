"""Single files of any kind, opened inside tasks by their full names as Spark gives them (``file:/a/b``, ``hdfs://host/a``)."""
from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..staging import shared_folder

LISTED = "dir string, name string, length bigint, folder boolean"
ROWS_PER_BATCH = 10_000
BYTES_PER_BATCH = 8 << 20


def hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and its full name, both as Java objects."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(where)


def locate(uri: str, systems: dict[str, tuple[pafs.FileSystem, str]]) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; ``systems`` keeps those that are open. Names are taken as they are, never decoded."""
    if uri.startswith("file:"):
        root, rest = "file:", uri[5:].lstrip("/")
        systems.setdefault(root, (pafs.LocalFileSystem(), ""))
    else:
        scheme, _, host, rest = uri.split("/", 3)
        root = f"{ {'s3a:': 's3:', 's3n:': 's3:'}.get(scheme, scheme)}//{host}"
        if root not in systems:
            system, base = pafs.FileSystem.from_uri(root + "/")
            systems[root] = system, base.rstrip("/")
    system, base = systems[root]
    return system, f"{base}/{rest}"


def heads(n_bytes: int):
    """For ``mapInArrow``: adds ``head``, the first bytes of the file named by ``uri``; NULL where there is no such file any more."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple[pafs.FileSystem, str]] = {}
        for batch in batches:
            out = []
            for uri in batch.column("uri").to_pylist():
                system, where = locate(uri, systems)
                try:
                    with system.open_input_file(where) as f:
                        out.append(f.read(n_bytes))
                except FileNotFoundError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "head"])
    return read


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(dir, name, length) of every file below ``root``, for trees of so many files that their names must not pass through the driver.

    Folders are listed by tasks, one level of the tree a round, and every round is written to the shared folder. Empty files and names that start
    with a dot or an underscore are left out, as by Spark's readers; one task lists a folder. ``dir`` is the folder's full name (``file:///a``).
    """
    out = f"{shared_folder(spark).rstrip('/')}/listing-{uuid.uuid4().hex}"
    top = hadoop(spark, root)[1].toString()
    parent, _, name = (top.replace("file:/", "file:///", 1) if top.startswith("file:/") and not top.startswith("file://") else top).rpartition("/")
    level, folders = 0, spark.range(1).select(F.lit(parent).alias("dir"), F.lit(name).alias("name"))
    while level == 0 or not folders.isEmpty():
        wide = folders.select("dir", "name").repartition(spark.sparkContext.defaultParallelism)
        wide.mapInArrow(_list, LISTED).write.parquet(f"{out}/level={level}")
        folders = spark.read.parquet(f"{out}/level={level}").filter("folder")
        level += 1
    return spark.read.schema(LISTED).parquet(out).filter("NOT folder AND length > 0").select("dir", "name", "length")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    systems: dict[str, tuple[pafs.FileSystem, str]] = {}
    for batch in batches:
        for parent, name in zip(batch.column("dir").to_pylist(), batch.column("name").to_pylist()):
            folder = f"{parent}/{name}"
            system, where = locate(folder, systems)
            found = [f for f in system.get_file_info(pafs.FileSelector(where)) if f.base_name[:1] not in (".", "_")]
            for i in range(0, len(found), ROWS_PER_BATCH):
                some = found[i:i + ROWS_PER_BATCH]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(some)), pa.array([f.base_name for f in some]), pa.array([f.size for f in some], pa.int64()),
                     pa.array([f.type == pafs.FileType.Directory for f in some])], ["dir", "name", "length", "folder"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (dir, name): (dir, value), the whole text of each file; a file that is gone by then has no row."""
    systems: dict[str, tuple[pafs.FileSystem, str]] = {}
    for batch in batches:
        dirs, values, size = [], [], 0
        for folder, name in zip(batch.column("dir").to_pylist(), batch.column("name").to_pylist()):
            system, where = locate(f"{folder}/{name}", systems)
            try:
                with system.open_input_stream(where, compression=None) as f:
                    value = f.read().decode("utf-8-sig", "replace")
            except FileNotFoundError:
                continue
            dirs.append(folder)
            values.append(value)
            size += len(value)
            if size >= BYTES_PER_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(dirs, pa.string()), pa.array(values, pa.string())], ["dir", "value"])
                dirs, values, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(dirs, pa.string()), pa.array(values, pa.string())], ["dir", "value"])


def csv_rows(columns: list[str]):
    """For ``mapInArrow`` over (dir, name): the wanted columns of CSV files as text, matched by header, read line by line; an empty cell is NULL."""
    names = ["dir", *columns]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple[pafs.FileSystem, str]] = {}
        out: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

        for batch in batches:
            for folder, name in zip(batch.column("dir").to_pylist(), batch.column("name").to_pylist()):
                system, where = locate(f"{folder}/{name}", systems)
                try:
                    stream = system.open_input_stream(where, compression=None)
                except FileNotFoundError:
                    continue
                with stream, io.TextIOWrapper(stream, "utf-8-sig", "replace", newline="") as lines:
                    rows = csv.reader(lines)
                    header = [h.strip().lower() for h in next(rows, [])]
                    lacking = [c for c in columns if c.lower() not in header]
                    if lacking:
                        raise ValueError(f"{folder}/{name}: no column {', '.join(lacking)}")
                    at = [header.index(c.lower()) for c in columns]
                    for row in rows:
                        if row:
                            out.append((folder, *[(row[i] or None) if i < len(row) else None for i in at]))
                        if len(out) >= ROWS_PER_BATCH:
                            yield batch_of(out)
                            out = []
        yield batch_of(out)
    return read


def write_files(files: DataFrame, root: str) -> int:
    """Write ``content`` (binary) of every row to ``path`` below ``root``; the number of files. A file made twice is the same file."""
    target = hadoop(files.sparkSession, root)[1].toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, tuple[pafs.FileSystem, str]] = {}
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                system, where = locate(f"{target}/{path}", systems)
                system.create_dir(where.rpartition("/")[0], recursive=True)
                with system.open_output_stream(where, compression=None) as f:  # a name that ends in .gz is only a name
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    return sum(r.n for r in files.select("path", "content").mapInArrow(write, "n bigint").groupBy().sum("n").toDF("n").collect() if r.n)
