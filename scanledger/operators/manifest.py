"""Manifests: label and metadata joins, merging, deduplication, pending work, coverage, records."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..checks import assert_empty, require_columns
from ..functions.ids import clean_key, label_column_name, known_number, strip_nifti_ext, text_is_true
from ..functions.numeric import count_if
from .kernels import classify
from .ordering import first_per, quantiles
from .splits import SPLITS, apply_splits, overlapping_patients

LABEL_PREFIX = "label_"


def rename_labels(labels: DataFrame, key: str) -> DataFrame:
    """Label columns under their manifest names."""
    return labels.select(key, *[F.col(f"`{c}`").alias(label_column_name(c)) for c in labels.columns if c != key])


def attach_labels(manifest: DataFrame, labels: DataFrame, manifest_key: str = "volume_id", labels_key: str = "volume_id",
                  order: str | None = None) -> DataFrame:
    """The manifest with ``label_*`` columns; old columns are replaced.

    Of a repeated label key the first row counts, by the column ``order`` (the readers can add one) or, where rows have no order, the
    row with the smallest values.
    """
    require_columns(manifest, [manifest_key], "the manifest")
    require_columns(labels, [labels_key], "the labels")
    place = F.col(order) if order else F.lit(0)
    keyed = labels.withColumn(labels_key, clean_key(F.col(labels_key).cast("string")))
    table = rename_labels(keyed.drop(order) if order else keyed, labels_key)
    values = [c for c in table.columns if c != labels_key]
    named = keyed.select(F.col(labels_key).alias("_key"), place.alias("_place"), *[F.col(f"`{c}`").alias(label_column_name(c)) for c in keyed.columns if c not in (labels_key, order)])
    table = named.groupBy("_key").agg(F.min(F.struct("_place", F.struct(*values).alias("row"))).getField("row").alias("_row"))
    base = manifest.drop(*values)
    joined = base.withColumn("_mkey", clean_key(F.col(manifest_key).cast("string"))).join(table, F.col("_mkey") == F.col("_key"), "left")
    return joined.select(*base.columns, *[F.col(f"_row.{c}").alias(c) for c in values])


def label_report(manifest: DataFrame, labels: DataFrame, manifest_key: str = "volume_id", labels_key: str = "volume_id") -> DataFrame:
    """One row: manifest rows, rows with labels, label keys matching nothing, repeated label keys."""
    left = manifest.groupBy(clean_key(F.col(manifest_key).cast("string")).alias("_k")).agg(F.count(F.lit(1)).alias("m"))
    right = labels.groupBy(clean_key(F.col(labels_key).cast("string")).alias("_k")).agg(F.count(F.lit(1)).alias("l"))
    both = left.join(right, "_k", "full")
    zero = F.lit(0)
    return both.agg(F.coalesce(F.sum("m"), zero).cast("bigint").alias("rows"),
                    F.coalesce(F.sum(F.when(F.col("l").isNotNull(), F.col("m"))), zero).cast("bigint").alias("rows_with_labels"),
                    count_if(F.col("m").isNull()).alias("unmatched_label_keys"),
                    F.coalesce(F.sum(F.col("l") - 1), zero).cast("bigint").alias("duplicate_label_keys"))


def unmatched_labels(manifest: DataFrame, labels: DataFrame, key: str = "volume_id") -> DataFrame:
    return labels.select(key).distinct().join(manifest.select(key), key, "left_anti")


def enrich(manifest: DataFrame, metadata: DataFrame, id_column: str = "VolumeName") -> DataFrame:
    """Metadata joined on the bare volume id; clashing names get the suffix ``_meta``."""
    renamed = [F.col(c).alias(f"{c}_meta" if c in manifest.columns else c) for c in metadata.columns if c != id_column]
    meta = metadata.select(strip_nifti_ext(F.col(id_column)).alias("_id"), *renamed)
    return manifest.join(meta, F.col("volume_id") == F.col("_id"), "left").drop("_id")


def attach_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return rows.join(stats, "volume_id", "left")


def dedupe(rows: DataFrame, order: Sequence[str], key: str = "volume_id") -> DataFrame:
    """The first row per id in ``order`` (ties by the remaining columns)."""
    return first_per(rows, [key], list(order))


def duplicates_dropped(rows: DataFrame, key: str = "volume_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").cast("bigint").alias("rows"), F.sum(F.col("n") - 1).cast("bigint").alias("duplicates_dropped"))


def with_kernel_columns(rows: DataFrame, kernel_table: DataFrame) -> DataFrame:
    """``manufacturer``, ``kernel``, ``kernel_class`` whichever source's column names the rows use."""
    if "Manufacturer" in rows.columns and "manufacturer" not in rows.columns:
        rows = rows.withColumnRenamed("Manufacturer", "manufacturer")
    kernel = "ConvolutionKernel" if "ConvolutionKernel" in rows.columns else "kernel"
    if "manufacturer" not in rows.columns or kernel not in rows.columns:
        return rows.withColumn("kernel", F.lit("")).withColumn("kernel_class", F.lit("other"))
    return classify(rows, kernel_table, kernel=kernel)


def merge_run(chunks: DataFrame, kernel_table: DataFrame, splits: DataFrame, labels: DataFrame | None = None, *,
              order: Sequence[str] = ("ingest_chunk",), label_order: str | None = None) -> DataFrame:
    """One row per volume of a run: deduplicated, classified, labelled (first row in ``label_order``), split."""
    out = with_kernel_columns(dedupe(chunks, order), kernel_table)
    if labels is not None:
        out = attach_labels(out, labels, order=label_order)
    return apply_splits(out, splits)


def reconcile(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Top-level folders on the checklist but not found, and found but not on the checklist."""
    found = rows.select(F.substring_index(F.col("scan_path"), "/", 1).alias("name")).distinct()
    listed = expected.select("name").distinct()
    return listed.join(found, "name", "left_anti").select("name", F.lit("missing").alias("side")).unionByName(
        found.join(listed, "name", "left_anti").select("name", F.lit("unexpected").alias("side")))


def suspicious_patients(rows: DataFrame, min_scans: int = 20, factor: float = 10.0) -> DataFrame:
    """Patients with implausibly many scans compared with the median patient."""
    counts = rows.groupBy("patient_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_scans"))
    median = quantiles(counts, [], "n_scans", {"m": 0.5}).scalar()
    return counts.filter(F.col("n_scans") > F.greatest(F.lit(float(min_scans)), F.lit(float(factor)) * median))


def run_record(manifest: DataFrame, failures: DataFrame, fingerprint: str) -> DataFrame:
    """One row: fingerprint, volumes, kernel classes, failed volumes."""
    failed = failures.agg(F.count(F.lit(1))).scalar()
    return manifest.agg(F.lit(fingerprint).alias("fingerprint"), F.count(F.lit(1)).cast("bigint").alias("n_volumes"),
                        *[count_if(F.col("kernel_class") == k).alias(f"n_{k}") for k in ("sharp", "soft", "other")]).withColumn(
        "n_failed_volumes", failed.cast("bigint"))


def pending(work: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Work items without a fresh cache row: same settings, and same raw signature where the raw file exists."""
    fresh = cache.filter(F.col("fingerprint") == fingerprint).select(F.col("volume_id").alias("_id"), F.col("signature").alias("_sig"))
    return work.join(fresh, (F.col("volume_id") == F.col("_id")) & (F.col("signature").isNull() | (F.col("signature") == F.col("_sig"))), "left_anti")


def missing_artifacts(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    return manifest.join(artifacts.select("volume_id"), "volume_id", "left_anti")


def select_volumes(manifest: DataFrame, splits: Sequence[str] = SPLITS, qc_passed_only: bool = True,
                   kernel_classes: Sequence[str] | None = None) -> DataFrame:
    """Rows to use: wanted splits, passed quality control, wanted kernels; one per id; labels numeric or NULL."""
    bad = set(splits) - set(SPLITS)
    if bad:
        raise ValueError(f"splits must be among {SPLITS}, got {sorted(bad)}")
    require_columns(manifest, ["volume_id", "patient_id", "split", "n_slices"], "the manifest")
    rows = manifest.filter(F.col("split").isin(*splits))
    if qc_passed_only and "qc_passed" in rows.columns:
        rows = rows.filter(text_is_true(F.col("qc_passed")))
    if kernel_classes is not None:
        require_columns(rows, ["kernel_class"], "the manifest")
        rows = rows.filter(F.col("kernel_class").isin(*kernel_classes))
    labels = label_names(manifest)
    kernel = F.coalesce("kernel_class", F.lit("")) if "kernel_class" in rows.columns else F.lit("")
    rows = rows.select("volume_id", "patient_id", "split", kernel.alias("kernel_class"), F.col("n_slices").cast("bigint").alias("n_slices"),
                       *[known_number(F.col(LABEL_PREFIX + n)).alias(LABEL_PREFIX + n) for n in labels])
    return first_per(rows, ["volume_id"], ["patient_id", "split"])


def label_names(manifest: DataFrame, subset: Sequence[str] | None = None) -> list[str]:
    """Label names in manifest order; a requested subset must exist."""
    names = [c[len(LABEL_PREFIX):] for c in manifest.columns if c.startswith(LABEL_PREFIX)]
    if subset is None:
        return names
    unknown = [n for n in subset if n not in names]
    if unknown or not subset:
        raise ValueError(f"unknown labels {unknown}; the manifest has {names}")
    return [n for n in names if n in subset]


def labels_long(manifest: DataFrame, ids: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """One row per (volume, label) with ``y`` (NULL = missing)."""
    names = label_names(manifest, labels)
    entries = F.array(*[F.struct(F.lit(n).alias("label"), known_number(F.col(LABEL_PREFIX + n)).alias("y")) for n in names])
    return manifest.select(*ids, F.inline(entries))


def combine_runs(manifests: Sequence[DataFrame], check: bool = True) -> DataFrame:
    """Several runs as one table, each volume once (the earliest run wins); label columns must agree.

    A patient with different splits in the runs would leak from one into the other: with ``check`` that is an error (one aggregate
    over the runs), otherwise ask ``split_clashes``.
    """
    first = sorted(c for c in manifests[0].columns if c.startswith(LABEL_PREFIX))
    for m in manifests[1:]:
        if sorted(c for c in m.columns if c.startswith(LABEL_PREFIX)) != first:
            raise ValueError("runs have different label columns")
    out = None
    for i, m in enumerate(manifests):
        m = m.withColumn("_run", F.lit(i))
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    combined = first_per(out, ["volume_id"], ["_run"]).drop("_run")
    if check and {"patient_id", "split"} <= set(combined.columns):
        assert_empty(split_clashes(combined), "patients with different splits in the runs")
    return combined


def split_clashes(combined: DataFrame) -> DataFrame:
    """Patients that combined runs put in more than one split, whichever source they come from."""
    return overlapping_patients(combined.select("patient_id", "split"))


def encode_plan(selected: DataFrame, done: DataFrame, dim: int, width: int) -> DataFrame:
    """Per split: volumes, slices, bytes, volumes already encoded (same slice count) and still to do."""
    ready = done.select("volume_id", F.col("n_slices").alias("_n")).distinct()
    rows = selected.join(ready, "volume_id", "left")
    n, ok = F.count(F.lit(1)), F.coalesce(F.col("_n") == F.col("n_slices"), F.lit(False))
    return rows.groupBy("split").agg(
        n.cast("bigint").alias("volumes"), F.sum("n_slices").cast("bigint").alias("slices"),
        (F.sum("n_slices") * dim * width).cast("bigint").alias("bytes"), count_if(ok).alias("done"), count_if(~ok).alias("to_do"))


def coverage(selected: DataFrame, encoded: DataFrame, kernels: Sequence[str]) -> DataFrame:
    """Volumes per split and kernel class: encoded and in total."""
    rows = selected.join(encoded.select("volume_id", F.lit(1).alias("_e")).distinct(), "volume_id", "left")
    return rows.groupBy("split").agg(*[c for k in kernels for c in (
        count_if((F.col("kernel_class") == k) & F.col("_e").isNotNull()).alias(f"encoded_{k}"), count_if(F.col("kernel_class") == k).alias(f"total_{k}"))])


def work_status(planned: DataFrame, chunk_state: DataFrame, manifest: DataFrame, qc: DataFrame) -> DataFrame:
    """Per stage: what is done, what is planned, and done / partial / todo."""
    ingest = planned.select("chunk").distinct().join(chunk_state.filter("done").select("chunk", F.lit(1).alias("_d")).distinct(), "chunk", "left").agg(
        F.lit("ingest").alias("stage"), F.count("_d").cast("bigint").alias("done"), F.count(F.lit(1)).cast("bigint").alias("total"))
    checked = manifest.select("volume_id").distinct().join(qc.select("volume_id", F.lit(1).alias("_d")).distinct(), "volume_id", "left").agg(
        F.lit("qc").alias("stage"), F.count("_d").cast("bigint").alias("done"), F.count(F.lit(1)).cast("bigint").alias("total"))
    split = manifest.agg(F.lit("splits").alias("stage"), count_if(F.col("split") != "unassigned").alias("done"), F.count(F.lit(1)).cast("bigint").alias("total"))
    state: Column = F.when(F.col("done") >= F.col("total"), "done").when(F.col("done") > 0, "partial").otherwise("todo")
    return ingest.unionByName(checked).unionByName(split).withColumn("state", state)




def set_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two sets holds, with the side; empty when the sets are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))
