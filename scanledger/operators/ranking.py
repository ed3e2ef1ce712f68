"""Ranking metrics from score blocks.

A *block* is one distinct score of one (group, label) with its volume count ``n`` and positive count
``n_pos``. Blocks are a partial aggregate, so volumes never meet in one task, ties are exact, and one
ranked block table serves AUROC, AUPRC, the max-F1 threshold and the thresholds at a specificity or
sensitivity.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import ratio
from .ordering import number_cell, prefix_sums
from .predictions import by_group


def score_blocks(long: DataFrame, keys: Sequence[str], score: str = "p", weight: Column | None = None) -> DataFrame:
    """Distinct scores per key with ``n`` and ``n_pos``; unknown labels are left out."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    known = long.filter(F.col("y").isNotNull())
    return known.groupBy(*keys, F.col(score).alias("p")).agg(
        F.sum(w).alias("n"), F.sum(F.when(F.col("y") == 1, w).otherwise(F.lit(0).cast("bigint"))).alias("n_pos"))


def grouped_blocks(long: DataFrame, group_columns: Sequence[str], score: str = "p") -> DataFrame:
    """Score blocks for the whole set and for every value of the grouping columns.

    Rows are combined per (label, group values, score) before they are multiplied by their groups.
    """
    base = score_blocks(long, ["label", *group_columns], score)
    return by_group(base, group_columns, ["label", "p", "n", "n_pos"]).groupBy("group_by", "group", "label", "p").agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


def rank_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds counts below each score (``n_before``, ``n_pos_before``) and totals of the key."""
    return prefix_sums(blocks, keys, number_cell(F.col("p")), ["p"], ["n", "n_pos"])


def _parts() -> dict[str, Column]:
    n, pos = F.col("n"), F.col("n_pos")
    neg, neg_before = n - pos, F.col("n_before") - F.col("n_pos_before")
    total_pos = F.col("n_pos_total")
    total_neg = F.col("n_total") - total_pos
    at_or_above = F.col("n_total") - F.col("n_before")
    pos_at_or_above = total_pos - F.col("n_pos_before")
    return dict(n=n, pos=pos, neg=neg, neg_before=neg_before, total_pos=total_pos, total_neg=total_neg,
                above=at_or_above, pos_above=pos_at_or_above, scorable=(total_pos > 0) & (total_neg > 0))


def auroc_expr() -> Column:
    """Mann-Whitney AUROC with ties counted half; NULL when only one class is present."""
    c = _parts()
    doubled = F.sum(c["pos"] * (2 * c["neg_before"] + c["neg"]))
    return ratio(doubled, 2 * F.max(c["total_pos"]) * F.max(c["total_neg"]))


def auprc_expr() -> Column:
    """Step-wise average precision over distinct scores; NULL when only one class is present."""
    c = _parts()
    return F.sum(F.when(c["scorable"], ratio(c["pos"], c["total_pos"]) * ratio(c["pos_above"], c["above"])))


def max_f1_expr() -> Column:
    """Score with the best F1, the lowest one among equals."""
    c = _parts()
    f1 = ratio(2 * c["pos_above"], c["above"] + c["total_pos"])
    return -F.max(F.when(c["scorable"], F.struct(f1.alias("f1"), (-F.col("p")).alias("m")))).getField("m")


def at_specificity_expr(specificity: float) -> Column:
    """Lowest threshold whose share of negatives below it reaches the target.

    It is the next double after the k-th smallest negative (the smallest negative itself when k = 0).
    """
    c = _parts()
    k = F.ceil(F.lit(float(specificity)) * c["total_neg"] - F.lit(1e-9))
    reached = c["scorable"] & (c["neg"] > 0) & (c["neg_before"] + c["neg"] >= k)
    score = F.min(F.when(reached, F.col("p")))
    return F.when(F.max(k) > 0, next_double(score)).otherwise(score)


def at_sensitivity_expr(sensitivity: float) -> Column:
    """Highest threshold whose share of positives at or above it reaches the target."""
    c = _parts()
    m = F.greatest(F.ceil(F.lit(float(sensitivity)) * c["total_pos"] - F.lit(1e-9)), F.lit(1))
    return F.max(F.when(c["scorable"] & (c["pos"] > 0) & (c["pos_above"] >= m), F.col("p")))


def next_double(x: Column) -> Column:
    """The next larger double. Runs on one row per label, not on data rows."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x).cast("double")


def ranking_metrics(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known volumes, positives, AUROC and AUPRC per key."""
    return ranked.groupBy(*keys).agg(
        F.max("n_total").cast("bigint").alias("n"), F.max("n_pos_total").cast("bigint").alias("n_pos"),
        auroc_expr().alias("auroc"), auprc_expr().alias("auprc"))


def thresholds(ranked: DataFrame, keys: Sequence[str], *, report_specificity: float = 0.95,
               ruleout_sensitivity: float = 0.90, fixed_specificities: Sequence[float] = (0.90, 0.95)) -> DataFrame:
    """Operating points per key: report, rule-out (never above report), max-F1, fixed specificities."""
    out = ranked.groupBy(*keys).agg(
        at_specificity_expr(report_specificity).alias("report"), at_sensitivity_expr(ruleout_sensitivity).alias("ruleout"),
        max_f1_expr().alias("max_f1"),
        *[at_specificity_expr(s).alias(f"spec{round(s * 100)}") for s in fixed_specificities])
    return out.withColumn("ruleout", F.when(F.col("ruleout").isNotNull(), F.least("ruleout", "report")))


def macro(per_label: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean over the labels that could be scored, and how many there were."""
    return per_label.groupBy(*keys).agg(
        F.count(metrics[0]).cast("bigint").alias("labels_scored"), *[F.avg(m).alias(f"macro_{m}") for m in metrics])


def average_ranks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank of every score within its key, ties sharing the mean of the ranks they cover."""
    ranked = prefix_sums(blocks, keys, number_cell(F.col("p")), ["p"], ["n"])
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).select(*keys, "p", "n", "rank")
