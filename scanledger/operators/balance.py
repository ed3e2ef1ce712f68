"""Class balance: histograms, crosstabs, prevalence by group, scanner dependence, findings per volume.

Label tables are long (``label``, ``y`` with NULL = missing) beside the grouping columns.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import chi_square_tail, count_if, ratio
from .ordering import quantiles


def class_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``column`` values per row value with an ``All`` row and column (rows with NULLs are left out)."""
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    base = known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    counts = base.rollup(row).agg(F.grouping(row).alias("_all"), *[
        F.coalesce(F.sum(F.when(F.col(column) == v, F.col("n"))), F.lit(0)).cast("bigint").alias(v) for v in values], F.sum("n").cast("bigint").alias("All"))
    return counts.select(F.when(F.col("_all") == 1, "All").otherwise(F.col(row)).alias(row), *values, "All")


def percent_of_group(df: DataFrame, row: str, column: str) -> DataFrame:
    """Count and share of every (row, column) pair within its row value."""
    base = df.groupBy(row, column).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    totals = base.groupBy(row).agg(F.sum("n").alias("_t"))
    return base.join(totals, row).select(row, column, "n", (ratio(F.col("n"), F.col("_t")) * 100).alias("percent"))


def prevalence(long: DataFrame, groups: Sequence[str], min_rows: int = 0) -> DataFrame:
    """Known rows, positives and prevalence per group and label; groups with few rows are left out."""
    out = long.groupBy(*groups, "label").agg(F.count(F.lit(1)).cast("bigint").alias("rows"), F.count("y").cast("bigint").alias("n"),
                                             F.sum("y").alias("n_pos"), F.avg("y").alias("prevalence"))
    return out.filter(F.col("rows") >= min_rows) if min_rows else out


def prevalence_spread(long: DataFrame, group: str, min_rows: int = 30) -> DataFrame:
    """Lowest and highest group prevalence per label beside the overall one."""
    per_group = prevalence(long, [group])
    large = F.col("rows") >= min_rows
    return per_group.groupBy("label").agg(
        ratio(F.sum("n_pos"), F.sum("n")).alias("overall"), F.min(F.when(large, F.col("prevalence"))).alias("lowest"),
        F.max(F.when(large, F.col("prevalence"))).alias("highest")).withColumn("spread", F.col("highest") - F.col("lowest"))


def scanner_dependence(long: DataFrame, group: str, min_rows: int = 30) -> DataFrame:
    """Chi-square statistic per label of the (negative, positive) x group table, with its degrees of freedom.

    With two groups the statistic has the continuity correction.
    """
    cells = long.filter(F.col("y").isNotNull() & F.col(group).isNotNull()).groupBy("label", group).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).filter(F.col("n") >= min_rows)
    totals = cells.groupBy("label").agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"), F.count(F.lit(1)).alias("k"))
    joined = cells.join(totals, "label")
    exp_pos = F.col("n") * F.col("all_pos") / F.col("all_n")
    exp_neg = F.col("n") - exp_pos

    def term(observed: Column, expected: Column) -> Column:
        gap = F.abs(observed - expected)
        gap = F.when(F.col("k") == 2, F.greatest(gap - 0.5, F.lit(0.0))).otherwise(gap)
        return ratio(gap * gap, expected)
    stat = F.sum(term(F.col("pos"), exp_pos) + term(F.col("n") - F.col("pos"), exp_neg))
    return joined.groupBy("label").agg(stat.alias("chi2"), (F.max("k") - 1).cast("bigint").alias("dof"))


def with_p_value(dependence: DataFrame) -> DataFrame:
    """Adds the chi-square tail probability (one row per label)."""
    return dependence.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof")))


def flag_dependence(dependence: DataFrame, spread: DataFrame, max_p: float = 0.001, min_spread: float = 0.05) -> DataFrame:
    return dependence.join(spread.select("label", "spread"), "label").withColumn(
        "flag", F.when((F.col("p_value") < max_p) & (F.col("spread") >= min_spread), "depends on scanner").otherwise(""))


def scans_with_kernel(volumes: DataFrame, kernel: str) -> DataFrame:
    """Per scan: whether it has the wanted kernel, its volumes and its scanner."""
    return volumes.groupBy("patient_id", "scan_id").agg(
        F.bool_or(F.coalesce(F.col("kernel_class") == kernel, F.lit(False))).alias("has_wanted"), F.count(F.lit(1)).cast("bigint").alias("n_recon"),
        F.min(F.struct("volume_id", "manufacturer")).getField("manufacturer").alias("manufacturer"))


def skipped_by_scanner(scans: DataFrame) -> DataFrame:
    """Scans without the wanted kernel per scanner, and their share."""
    return scans.groupBy("manufacturer").agg(count_if(~F.col("has_wanted")).alias("skipped"), F.count(F.lit(1)).cast("bigint").alias("of_scans")).filter(
        "skipped > 0").withColumn("percent", ratio(F.col("skipped"), F.col("of_scans")) * 100)


def skip_label_difference(volumes: DataFrame, long: DataFrame, scans: DataFrame) -> DataFrame:
    """Prevalence of every label in skipped and kept scans (first volume of a scan) and the difference in points."""
    first = volumes.groupBy("patient_id", "scan_id").agg(F.min("volume_id").alias("volume_id")).join(
        scans.select("patient_id", "scan_id", "has_wanted"), ["patient_id", "scan_id"])
    rows = long.select("volume_id", "label", "y").join(first.select("volume_id", "has_wanted"), "volume_id")
    skipped, kept = (F.avg(F.when(c, F.col("y"))) * 100 for c in (~F.col("has_wanted"), F.col("has_wanted")))
    return rows.groupBy("label").agg(skipped.alias("skipped"), kept.alias("kept")).withColumn("difference", F.col("skipped") - F.col("kept"))


def split_overview(manifest: DataFrame) -> DataFrame:
    """Volumes, scans, patients and share of volumes per split, from one pass over per-scan counts."""
    per_scan = manifest.groupBy("split", "patient_id", "scan_id").agg(F.count(F.lit(1)).alias("n"))
    per_patient = per_scan.groupBy("split", "patient_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scans"))
    out = per_patient.groupBy("split").agg(F.sum("n").cast("bigint").alias("volumes"), F.sum("scans").cast("bigint").alias("scans"),
                                           F.count(F.lit(1)).cast("bigint").alias("patients"))
    total = manifest.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("percent", ratio(F.col("volumes"), total) * 100)


def prevalence_gap(long: DataFrame) -> DataFrame:
    """Prevalence per split in percent, gaps to train in points, and negatives per positive in train."""
    def of(split: str) -> Column:
        return F.avg(F.when(F.col("split") == split, F.col("y")))
    train = F.col("split") == "train"
    pos = F.sum(F.when(train, F.col("y")))
    known = F.count(F.when(train & F.col("y").isNotNull(), F.lit(1)))
    return long.groupBy("label").agg((of("train") * 100).alias("train"), (of("val") * 100).alias("val"), (of("test") * 100).alias("test"),
                                     (F.avg("y") * 100).alias("all"), ratio(known - pos, pos).alias("pos_weight")).withColumn(
        "val_minus_train", F.col("val") - F.col("train")).withColumn("test_minus_train", F.col("test") - F.col("train"))


def labels_without_positives(long: DataFrame) -> DataFrame:
    """Labels with no positive training row: pos_weight is undefined; empty when usable."""
    train = long.filter("split = 'train'")
    return train.groupBy("label").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("n_pos")).filter("n_pos = 0")


def findings_per_volume(long: DataFrame, top: int = 5) -> DataFrame:
    """Volumes per split by number of positive labels, everything from ``top`` up pooled."""
    n = long.groupBy("split", "volume_id").agg(F.coalesce(F.sum("y"), F.lit(0.0)).cast("bigint").alias("n"))
    bucket = F.when(F.col("n") >= top, f"{top}+").otherwise(F.col("n").cast("string"))
    counts = n.groupBy("split", bucket.alias("findings")).agg(F.count(F.lit(1)).cast("bigint").alias("volumes"))
    totals = counts.groupBy("split").agg(F.sum("volumes").alias("_t"))
    return counts.join(totals, "split").select("split", "findings", "volumes", (ratio(F.col("volumes"), F.col("_t")) * 100).alias("percent"))


def findings_stats(long: DataFrame) -> DataFrame:
    """Mean, median and maximum number of positive labels per volume and split."""
    n = long.groupBy("split", "volume_id").agg(F.coalesce(F.sum("y"), F.lit(0.0)).alias("n"))
    plain = n.groupBy("split").agg(F.avg("n").alias("mean"), F.max("n").alias("max"))
    return plain.join(quantiles(n, ["split"], "n", {"median": 0.5}), "split")
