"""Readers. Every one declares its schema or reads Parquet, so nothing is inferred on large inputs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..checks import CheckFailed
from ..functions.ids import (ARCHIVE_SUFFIX, archive_chunk_id, file_suffix, has_dicom_marker, is_dicom_name, is_nifti_name, strip_nifti_ext)
from .raw import heads

HEAD_BYTES = 132  # the marker ends here

METADATA_SCHEMA = ("VolumeName string, Manufacturer string, ConvolutionKernel string, SeriesDescription string, Rows string, Columns string, "
                   "NumberofSlices string, XYSpacing string, ZSpacing string, RescaleSlope string, RescaleIntercept string")
SIDECAR_SCHEMA = ("fingerprint string, version string, source_signature string, calibration map<string,string>, "
                  "loader_checks struct<z_uniform:boolean,slice_axis_tilt_deg:double>, "
                  "stats struct<n_slices:bigint,spacing_z_mm:double,spacing_y_mm:double,spacing_x_mm:double,crop_shape:string,qc_passed:boolean>, "
                  "_corrupt_record string")


def read_metadata(spark: SparkSession, paths: dict[str, str], schema: str = METADATA_SCHEMA) -> DataFrame:
    """Both pools' metadata CSVs with their pool; names without the file extension."""
    out = None
    for pool, path in paths.items():
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumn("pool", F.lit(pool))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("VolumeName", strip_nifti_ext(F.col("VolumeName")))


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_keyed_labels(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """A label file: first column the text key, the others numbers; at least one label column.

    ``order`` names a column to add that sorts rows as they stand in the files, files by name.
    """
    names = _header(spark, path)
    if len(names) < 2:
        raise CheckFailed(f"{path}: expected a key column followed by at least one label column")
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(F.col(f"`{names[0]}`"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in names[1:]],
                      *([F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(order)] if order else []))


def read_labels(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """The label files that exist as one frame keyed by ``volume_id``; None when there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = None
    for path in paths:
        where = hadoop.Path(path)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            continue
        df = read_keyed_labels(spark, path)
        key = df.columns[0]
        df = df.withColumn(key, strip_nifti_ext(F.col(key))).withColumnRenamed(key, "volume_id")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_chunk_manifests(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of a run; chunks may have different columns."""
    return spark.read.option("mergeSchema", True).parquet(path).withColumn("ingest_chunk", F.col("ingest_chunk").cast("string"))


def read_sidecars(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """One row per readable sidecar; an unreadable one counts as missing.

    Either one JSON document per file named ``<volume id>.meta.json``, or JSON lines that carry ``volume_id``.
    """
    if one_per_file:
        df = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        df = df.withColumn("volume_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.meta\.json$", 1))
    else:
        df = spark.read.schema("volume_id string, " + SIDECAR_SCHEMA).option("mode", "PERMISSIVE").json(path)
    readable = F.col("_corrupt_record").isNull() & F.col("fingerprint").isNotNull()
    return df.filter(readable).select("volume_id", *[c for c in df.columns if c not in ("volume_id", "_corrupt_record")])


def read_inventory(spark: SparkSession, root: str, uri: bool = False) -> DataFrame:
    """Every file below ``root``: relative path and length, without reading any; ``uri`` adds where each lies.

    Empty files and files or folders whose names start with a dot or an underscore are left out, as by all of Spark's readers.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^.*?" + _escaped(root.rstrip("/")) + "/", "")
    return df.select(rel.alias("path"), F.col("length").cast("bigint").alias("length"), *([F.col("path").alias("uri")] if uri else []))


def _escaped(text: str) -> str:
    import re
    return re.escape(text)


def sniff_types(files: DataFrame) -> DataFrame:
    """``dicom``, ``nifti`` or ``other`` per file of ``read_inventory(uri=True)``, by suffix and marker bytes.

    Only files without a suffix are opened, and only their first bytes are read, file by file in Arrow batches; all
    others are told by their names. ``uri`` is dropped, all other columns stay. A file that is gone by then is ``other``.
    """
    path = F.col("path")
    suffix = file_suffix(path)
    named = files.filter((suffix != "") | suffix.isNull()).withColumn(
        "kind", F.when(is_nifti_name(path), "nifti").when(is_dicom_name(path), "dicom").otherwise("other"))
    bare = files.filter(suffix == "")
    schema = T.StructType([*bare.schema.fields, T.StructField("head", T.BinaryType())])
    opened = bare.mapInArrow(heads(HEAD_BYTES), schema).withColumn("kind", F.when(has_dicom_marker(F.col("head")), "dicom").otherwise("other")).drop("head")
    return named.unionByName(opened).drop("uri")


def folder_of(path: Column) -> Column:
    return F.when(F.locate("/", path) == 0, F.lit(".")).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def hidden(path: Column) -> Column:
    """Below a folder whose name starts with a dot."""
    return F.coalesce(path.rlike(r"(^|/)\.[^/]+/"), F.lit(False))


def source_signature(files: DataFrame, keys: Sequence[str] = ("folder",)) -> DataFrame:
    """``file_count:total_bytes`` per scan folder (and series)."""
    return files.withColumn("folder", folder_of(F.col("path"))).groupBy(*keys).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum("length").cast("string")).alias("signature"))


def discover_scans(files: DataFrame, fmt: str = "auto", only_folders: Sequence[str] = (), max_scans: int | None = None) -> DataFrame:
    """One row per scan: a NIfTI file, or one series of DICOM files in a folder.

    ``files`` has path and series_uid (NULL when the header could not be read: such a file is no scan).
    """
    seen = files.filter(~hidden(F.col("path")))
    out = None
    if fmt in ("dicom", "auto"):
        kind = F.col("kind") == "dicom" if "kind" in files.columns else is_dicom_name(F.col("path"))
        out = seen.filter(kind & F.col("series_uid").isNotNull()).groupBy(folder_of(F.col("path")).alias("scan_path"), "series_uid").agg(
            F.count(F.lit(1)).cast("bigint").alias("n_files")).select("scan_path", F.lit("dicom").alias("format"), "n_files", "series_uid")
    if fmt in ("nifti", "auto"):
        nifti = seen.filter(is_nifti_name(F.col("path"))).groupBy(F.col("path").alias("scan_path")).agg(F.lit(1).cast("bigint").alias("n_files")).select(
            "scan_path", F.lit("nifti").alias("format"), "n_files", F.lit(None).cast("string").alias("series_uid"))
        out = nifti if out is None else out.unionByName(nifti)
    wanted = [w.strip().strip("/") for w in only_folders if w.strip()]
    if wanted:
        keep = F.lit(False)
        for w in wanted:
            keep = keep | (F.col("scan_path") == w) | F.col("scan_path").startswith(w + "/")
        out = out.filter(keep)
    if max_scans:
        out = out.orderBy("scan_path", F.coalesce("series_uid", F.lit(""))).limit(max_scans)
    return out


def archive_chunks(files: DataFrame) -> DataFrame:
    """Archives among the files: chunk id and name; other files are ignored."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.filter(F.col("path").rlike(ARCHIVE_SUFFIX)).select(archive_chunk_id(name).alias("chunk_id"), name.alias("name"))


def checklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Names of a checklist: trimmed, without trailing separators, blank and comment lines, as ``name``."""
    name = F.regexp_replace(F.trim(F.col(column)), r"[/\\]+$", "")
    return lines.select(name.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_checklist(spark: SparkSession, path: str) -> DataFrame:
    return checklist(spark.read.text(path))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("volume_id", "slice_idx", "emb")
