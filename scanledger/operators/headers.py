"""Slice headers: geometry, summaries and manifests of imaging series.

A header row is (folder, series_uid, file, n_rows, n_cols, iop, ipp, pixel_spacing, slice_thickness, tags...).
A series is one acquisition (hundreds of slices), so ordering its header rows is small work.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import id_hash
from ..functions.ids import patient_key, scan_id
from ..functions.vectors import dot, norm
from .ordering import quantiles

KEYS = ["folder", "series_uid"]
# fixed values: required tags and the texts of geometry problems
PROBLEMS = {
    "shapes": "slices in one series have different Rows/Columns",
    "missing": "missing required DICOM tag %s in at least one slice",
    "duplicates": "duplicate slice positions in this series",
}
REQUIRED = {"iop": "ImageOrientationPatient", "ipp": "ImagePositionPatient", "pixel_spacing": "PixelSpacing"}


def _cross(v: Column) -> Column:
    a, b = [v[i] for i in range(3)], [v[i] for i in range(3, 6)]
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _first_of_series(headers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The header of the first file (by name) of every series."""
    return headers.groupBy(*KEYS).agg(F.min(F.struct("file", *columns)).alias("_f")).select(*KEYS, *[F.col(f"_f.{c}").alias(c) for c in columns])


def slice_gaps(headers: DataFrame) -> DataFrame:
    """Each slice's projection on the slice normal and the gap to the one before it."""
    first = _first_of_series(headers, ["iop"]).withColumn("_n", _cross(F.col("iop"))).withColumn(
        "_normal", F.zip_with("_n", F.array_repeat(norm(F.col("_n")), 3), lambda x, s: x / s)).select(*KEYS, "_normal")
    placed = headers.filter("ipp IS NOT NULL").select(*KEYS, "file", "ipp").join(first, KEYS).withColumn("proj", dot(F.col("ipp"), F.col("_normal")))
    order = W.partitionBy(*KEYS).orderBy("proj", "file")
    return placed.withColumn("gap", F.col("proj") - F.lag("proj").over(order))


def slice_geometry(headers: DataFrame) -> DataFrame:
    """Per series: spacing, uniformity and tilt, or the problem that makes its geometry unusable."""
    checks = headers.groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"), F.count_distinct("n_rows", "n_cols").alias("_shapes"),
        *[(F.count(c) < F.count(F.lit(1))).alias(f"_no_{c}") for c in REQUIRED],
        F.min(F.struct("file", "pixel_spacing", "slice_thickness", "n_rows", "n_cols")).alias("_f"))
    gaps = slice_gaps(headers)
    step = gaps.groupBy(*KEYS).agg(
        F.min("gap").alias("_lo"), F.max("gap").alias("_hi"), F.min(F.struct("proj", "file", "ipp", "_normal")).alias("_a"),
        F.max(F.struct("proj", "file", "ipp")).alias("_b"), F.count(F.lit(1)).alias("_k"))
    median = quantiles(gaps.select(*KEYS, "gap"), KEYS, "gap", {"z_median": 0.5})
    joined = checks.join(step, KEYS, "left").join(median, KEYS, "left")
    move = F.zip_with(F.zip_with("_b.ipp", "_a.ipp", lambda x, y: x - y), F.array_repeat(F.col("_k") - 1, 3), lambda d, n: d / n)
    cos = F.least(F.abs(dot(move, F.col("_a._normal"))) / norm(move), F.lit(1.0))
    many = F.col("_k") > 1
    missing = F.lit(None).cast("string")
    for c, tag in reversed(REQUIRED.items()):
        missing = F.when(F.col(f"_no_{c}"), PROBLEMS["missing"] % tag).otherwise(missing)
    problem = F.when(F.col("_shapes") > 1, PROBLEMS["shapes"]).otherwise(
        F.coalesce(missing, F.when(F.col("_lo") < 1e-3, PROBLEMS["duplicates"])))
    out = joined.withColumn("geometry_problem", problem)
    ok = F.col("geometry_problem").isNull()

    def known(c: Column) -> Column:
        return F.when(ok, c)
    return out.select(
        *KEYS, "n_files", F.col("_f.n_rows").alias("n_rows"), F.col("_f.n_cols").alias("n_cols"),
        known(F.when(many, F.col("z_median")).otherwise(F.coalesce("_f.slice_thickness", F.lit(1.0)))).alias("z_spacing"),
        known(F.when(many, F.col("_hi") - F.col("_lo") < F.lit(0.1) * F.col("z_median")).otherwise(True)).alias("z_uniform"),
        known(F.when(many, F.degrees(F.acos(cos))).otherwise(0.0)).alias("tilt_deg"),
        known(F.col("_f.pixel_spacing")[0]).alias("row_spacing"), known(F.col("_f.pixel_spacing")[1]).alias("col_spacing"), "geometry_problem")


def header_summary(headers: DataFrame, tags: Sequence[str] = ("manufacturer", "kernel")) -> DataFrame:
    """One row per series: whitelisted tags, series in its folder, geometry or its problem, hashed patient id."""
    first = _first_of_series(headers, [*tags, "patient_tag"])
    series = headers.select(*KEYS).distinct().groupBy("folder").agg(F.count(F.lit(1)).cast("bigint").alias("n_series"))
    tag = F.coalesce("patient_tag", F.lit(""))
    return slice_geometry(headers).join(first, KEYS).join(series, "folder").select(
        *KEYS, "n_files", "n_series", "n_rows", "n_cols", *tags, "z_spacing", "z_uniform", "tilt_deg", "row_spacing", "col_spacing", "geometry_problem",
        (tag != "").alias("patient_id_present"), id_hash(F.col("patient_tag")).alias("patient_id_hash"))


def patient_id_source(summary: DataFrame, recorded: str | None = None) -> DataFrame:
    """One row: group patients by tag only when it is present and distinct on every series; a recorded choice stays."""
    n, present = F.count(F.lit(1)), F.count_if("patient_id_present")
    distinct = F.count_distinct(F.when(F.col("patient_id_present"), F.col("patient_id_hash")))
    auto = F.when((n > 0) & (present == n) & (distinct == present), "dicom_tag").otherwise("path")
    return summary.agg(present.cast("bigint").alias("present"), distinct.cast("bigint").alias("distinct_ids"), n.cast("bigint").alias("scans"),
                       (F.lit(recorded) if recorded else auto).alias("patient_id_source"))


def folder_manifest(scans: DataFrame, summary: DataFrame, patient_depth: int = 1, source: str = "auto", recorded: str | None = None) -> DataFrame:
    """One row per discovered scan with its id, patient, acquisition columns or the problem met."""
    dicom = F.col("format") == "dicom"
    facts = summary.withColumnRenamed("folder", "_folder").withColumnRenamed("series_uid", "_series").drop("n_files")
    joined = scans.join(facts, dicom & (F.col("scan_path") == F.col("_folder")) & (F.col("series_uid") == F.col("_series")), "left")
    choice = patient_id_source(summary, recorded).select("patient_id_source").scalar() if source == "auto" else F.lit(source)
    by_path = patient_key(F.col("scan_path"), patient_depth)
    tagged = dicom & F.coalesce("patient_id_present", F.lit(False)) & (F.col("_choice") == "dicom_tag")
    return joined.withColumn("_choice", choice).select(
        F.when(dicom, scan_id(F.col("scan_path"), F.col("series_uid"))).otherwise(scan_id(F.col("scan_path"))).alias("volume_id"),
        F.when(tagged, F.concat(F.lit("dicom_"), F.col("patient_id_hash"))).otherwise(by_path).alias("patient_id"),
        "scan_path", "format", "n_files", "series_uid", "n_rows", "n_cols", "manufacturer", "kernel",
        F.when(dicom & F.col("_series").isNull(), "no readable header").otherwise(F.col("geometry_problem")).alias("manifest_problem"))


def duplicate_ids(manifest: DataFrame) -> DataFrame:
    """Scan ids that occur more than once; empty when ids are unique."""
    return manifest.groupBy("volume_id").agg(F.count(F.lit(1)).cast("bigint").alias("n")).filter("n > 1")
