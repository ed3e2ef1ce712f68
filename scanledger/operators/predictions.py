"""Predictions: wide <-> long, grouping views, members of an ensemble."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import known_number

PAIR_KERNELS = ("sharp", "soft")


def label_names(df: DataFrame, prefix: str = "true_") -> list[str]:
    return [c[len(prefix):] for c in df.columns if c.startswith(prefix)]


def to_long(wide: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per (volume, label) with probability ``p`` and label ``y`` (NULL = unknown)."""
    labels = list(labels) if labels is not None else label_names(wide)
    missing = [c for n in labels for c in (f"prob_{n}", f"true_{n}") if c not in wide.columns]
    if missing or not labels:
        raise ValueError(f"predictions lack the columns {missing or 'prob_* / true_*'}")
    entries = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"prob_{n}").cast("double").alias("p"),
                                 known_number(F.col(f"true_{n}")).alias("y")) for n in labels])
    ids = [c for c in wide.columns if not c.startswith(("prob_", "true_"))]
    return wide.select(*ids, F.inline(entries))


def to_wide(long: DataFrame, ids: Sequence[str], values: dict[str, str], labels: Sequence[str]) -> DataFrame:
    """Back to one row per volume; ``values`` maps an output prefix to a long column."""
    cols = [F.max(F.when(F.col("label") == n, F.col(c))).alias(f"{prefix}{n}")
            for n in labels for prefix, c in values.items()]
    return long.groupBy(*ids).agg(*cols)


def memberships(group_columns: Sequence[str], base: Column | None = None) -> Column:
    """Array of (group_by, group): the whole set, then every grouping column's value (NULL -> unknown)."""
    entries = [F.struct(F.lit("all").alias("group_by"), F.lit("all").alias("group"))]
    entries += [F.struct(F.lit(c).alias("group_by"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("group"))
                for c in group_columns]
    return F.array(*entries)


def by_group(df: DataFrame, group_columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Every row once per group it belongs to. Apply it to aggregated rows: it multiplies them."""
    return df.select(F.inline(memberships(group_columns)), *keep)


def group_sizes(wide: DataFrame, group_columns: Sequence[str], min_group: int) -> DataFrame:
    """Volumes and patients per group, small groups flagged."""
    per_patient = wide.groupBy("patient_id", *group_columns).agg(F.count(F.lit(1)).alias("n"))
    per_patient = by_group(per_patient, group_columns, ["patient_id", "n"]).groupBy("group_by", "group", "patient_id").agg(
        F.sum("n").alias("n"))
    return per_patient.groupBy("group_by", "group").agg(
        F.sum("n").cast("bigint").alias("n_volumes"), F.count(F.lit(1)).cast("bigint").alias("n_patients")).withColumn(
        "too_small", F.col("n_volumes") < min_group)


def finished_members(members: DataFrame, status: DataFrame, evaluation: str) -> DataFrame:
    """Stacked predictions (member, eval, ...) of one evaluation, of the members whose run is finished (``status``: member, status)."""
    done = status.filter("status = 'finished'").select("member")
    return members.filter(F.col("eval") == evaluation).join(done, "member", "left_semi").select(*members.columns)


def average_members(members: DataFrame, labels: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Mean probability per volume over the ``member`` column of stacked predictions, to 12 digits: the order in which members are added
    up must not decide whether two volumes tie."""
    return members.groupBy("volume_id").agg(
        *[F.min(c).alias(c) for c in ids if c != "volume_id"],
        *[F.round(F.avg(f"prob_{n}"), 12).alias(f"prob_{n}") for n in labels],
        *[F.max(f"true_{n}").alias(f"true_{n}") for n in labels])


def misaligned_members(members: DataFrame) -> DataFrame:
    """Volumes that some member of the ensemble lacks or holds more than once; empty when aligned."""
    n = members.agg(F.count_distinct("member")).scalar()
    return members.groupBy("volume_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.count_distinct("member").cast("bigint").alias("members")).filter(
        (F.col("members") != n) | (F.col("rows") != n))


def attach_columns(predictions: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join the manifest columns the predictions lack, one manifest row per volume."""
    add = [c for c in columns if c in manifest.columns and c not in predictions.columns]
    if not add:
        return predictions
    one = manifest.groupBy("volume_id").agg(F.min(F.struct(*add)).alias("_m")).select("volume_id", *[f"_m.{c}" for c in add])
    return predictions.join(one, "volume_id", "left")


def scan_key() -> Column:
    return F.concat_ws("/", F.col("patient_id").cast("string"), F.col("scan_id").cast("string"))


def kernel_pairs(volumes: DataFrame, order: str = "volume_id") -> DataFrame:
    """One (sharp, soft) pair of volumes per scan, the first of each in ``order``."""
    usable = volumes.filter(F.col("scan_id").isNotNull() & F.col("kernel_class").isin(*PAIR_KERNELS))
    first = [F.min(F.when(F.col("kernel_class") == k, F.struct(F.col(order).alias("o"), F.col("volume_id").alias("v")))).alias(k)
             for k in PAIR_KERNELS]
    pairs = usable.groupBy(scan_key().alias("scan")).agg(*first)
    return pairs.filter(F.col("sharp").isNotNull() & F.col("soft").isNotNull()).select(
        "scan", F.col("sharp.v").alias("sharp_volume"), F.col("soft.v").alias("soft_volume"))


def scan_items(volumes: DataFrame) -> DataFrame:
    """Pairs as one item with two views; every other volume as its own item."""
    keyed = volumes.select("volume_id", "patient_id", "scan_id", "kernel_class")
    last = [F.max(F.when(F.col("kernel_class") == k, F.col("volume_id"))).alias(k) for k in PAIR_KERNELS]
    pairs = keyed.groupBy(scan_key().alias("scan")).agg(*last).filter("sharp IS NOT NULL AND soft IS NOT NULL")
    used = pairs.select(F.explode(F.array("sharp", "soft")).alias("volume_id"))
    singles = keyed.join(used, "volume_id", "left_anti")
    return pairs.select(F.col("scan").alias("item"), F.lit(2).cast("bigint").alias("n_views"),
                        F.col("sharp").alias("first_view"), F.col("soft").alias("second_view")).unionByName(
        singles.select(F.concat(scan_key(), F.lit("#"), F.col("volume_id")).alias("item"), F.lit(1).cast("bigint").alias("n_views"),
                       F.col("volume_id").alias("first_view"), F.lit(None).cast("string").alias("second_view")))
