"""Evaluation and the clinical scorecard as bundles of DataFrames."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bootstrap as B, calibration as C, scorecard as S
from ..operators.predictions import average_members, finished_members, group_sizes, kernel_pairs, label_names, to_long
from ..operators.ranking import auroc_expr, grouped_blocks, macro, rank_blocks, ranking_metrics, score_blocks, thresholds

GROUPS = ("kernel_class", "manufacturer")


@dataclass(frozen=True)
class ReportSettings:
    report_specificity: float = 0.95
    ruleout_sensitivity: float = 0.90
    calibration: str = "platt"
    calibration_by_kernel: bool = False
    min_calibration_volumes: int = 100
    fixed_specificities: tuple[float, ...] = (0.90, 0.95)
    net_benefit_thresholds: tuple[float, ...] = (0.05, 0.10, 0.20)
    calibration_bins: int = 10
    bootstrap: int = 1000
    ci_groups: tuple[str, ...] = ("all", "kernel_class")
    min_group: int = 100
    gate: dict = field(default_factory=dict)


def per_label_metrics(long: DataFrame, group_columns: Sequence[str]) -> DataFrame:
    """n, n_pos, AUROC and AUPRC per (group, label)."""
    keys = ["group_by", "group", "label"]
    return ranking_metrics(rank_blocks(grouped_blocks(long, group_columns), keys), keys)


def micro_of(grouped: DataFrame) -> DataFrame:
    """AUROC over all (volume, label) pairs per group, from grouped blocks."""
    keys = ["group_by", "group"]
    blocks = grouped.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
    return rank_blocks(blocks, keys).groupBy(*keys).agg(auroc_expr().alias("micro_auroc"))


def micro_auroc(long: DataFrame, group_columns: Sequence[str]) -> DataFrame:
    return micro_of(grouped_blocks(long, group_columns))


def max_f1_thresholds(val_long: DataFrame) -> DataFrame:
    ranked = rank_blocks(score_blocks(val_long, ["label"]), ["label"])
    return thresholds(ranked, ["label"]).select("label", F.col("max_f1").alias("threshold"))


def evaluate(wide: DataFrame, frozen: DataFrame, group_columns: Sequence[str] = GROUPS, *, n_boot: int = 1000, seed: int = 0,
             min_group: int = 100) -> dict[str, DataFrame]:
    """Group summary and per-label table of a prediction frame under frozen validation thresholds."""
    group_columns = [c for c in group_columns if c in wide.columns]
    long = to_long(wide)
    grouped = S.spread(S.label_blocks(long, group_columns), group_columns)
    rates = S.thresholded(grouped, frozen, S.KEYS).drop("tp", "fp", "fn", "tn")
    per_label = ranking_metrics(rank_blocks(grouped, S.KEYS), S.KEYS).join(rates, S.KEYS, "left")
    group = ["group_by", "group"]
    sizes = group_sizes(wide, group_columns, min_group)
    summary = sizes.join(macro(per_label, group, ["auroc", "auprc", "f1", "sensitivity", "specificity", "ppv"]), group, "left").join(
        micro_of(grouped), group, "left")
    if n_boot:
        ci = B.macro_intervals(long, n_boot, seed, group_columns=group_columns, groups=sizes.filter("NOT too_small"))
        summary = summary.join(ci.select(*group, *[F.col(c).alias(f"macro_{c}") for c in ci.columns if c not in group]), group, "left")
    return {"summary": summary, "per_label": per_label}


def operating_points(spark: SparkSession, val_long: DataFrame, settings: ReportSettings) -> tuple[DataFrame, DataFrame]:
    """(calibration parameters, thresholds per label), both chosen on validation predictions."""
    if settings.calibration == "none":
        params, calibrated = C.identity(val_long), val_long.withColumn("q", F.col("p"))
    else:
        params = C.fit(spark, val_long, settings.calibration, by_kernel=settings.calibration_by_kernel,
                       min_volumes=settings.min_calibration_volumes)
        calibrated = C.apply(val_long, params, "q")
    ranked = rank_blocks(score_blocks(calibrated, ["label"], "q"), ["label"])
    return params, thresholds(ranked, ["label"], report_specificity=settings.report_specificity,
                              ruleout_sensitivity=settings.ruleout_sensitivity, fixed_specificities=settings.fixed_specificities)


def score(spark: SparkSession, val: DataFrame, test: DataFrame, settings: ReportSettings = ReportSettings(),
          seed: int = 0) -> dict[str, DataFrame]:
    """Every table of the report: points chosen on ``val``, everything else measured on ``test``."""
    labels = label_names(test)
    groups = [c for c in GROUPS if c in test.columns]
    group_keys, keys = ["group_by", "group"], ["group_by", "group", "label"]
    params, points = operating_points(spark, to_long(val), settings)
    long = to_long(test)
    if settings.calibration == "none":
        long = long.withColumn("p_raw", F.col("p"))
    else:
        long = C.apply(long, params).withColumnRenamed("p", "p_raw").withColumnRenamed("p_cal", "p")
    fixed = [f"spec{round(s * 100)}" for s in settings.fixed_specificities]
    grouped = S.spread(S.label_blocks(long, groups, ("p_raw", "p")), groups)
    per_label = S.per_label_table(S.decide(grouped, points), fixed, settings.net_benefit_thresholds)
    by_score = grouped.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
    per_label = per_label.join(ranking_metrics(rank_blocks(by_score, keys), keys).select(*keys, "auroc", "auprc"), keys, "left")
    for name, col in (("ece_raw", "p_raw"), ("ece", "p")):
        per_label = per_label.join(S.calibration_error(grouped, col, settings.calibration_bins, name), keys, "left")
    per_label = per_label.join(points, "label", "left")
    decided = S.decide(long, points)
    ids = [c for c in ("volume_id", "patient_id", "split", "scan_id", "kernel_class", "manufacturer") if c in test.columns]
    scans = S.per_scan(decided, ids)
    means = ["auroc", "auprc", "report_sens", "report_spec", "report_ppv", "maxf1_sens", "maxf1_spec", "ece_raw", "ece"]
    summary = S.scan_summary(scans, groups, settings.min_group).join(
        per_label.groupBy(*group_keys).agg(*[F.avg(m).alias(_macro_name(m)) for m in means]), group_keys, "left")
    if settings.bootstrap:
        ci_columns = [c for c in groups if c in settings.ci_groups]
        sizes = group_sizes(test, ci_columns, settings.min_group).filter("NOT too_small")
        if "all" not in settings.ci_groups:
            sizes = sizes.filter("group_by <> 'all'")
        ci = B.label_intervals(long, settings.bootstrap, seed, group_columns=ci_columns, groups=sizes)
        per_label = per_label.join(ci.select(*keys, "auroc_ci_low", "auroc_ci_high"), keys, "left")
    else:
        per_label = per_label.withColumn("auroc_ci_low", F.lit(None).cast("double")).withColumn("auroc_ci_high", F.lit(None).cast("double"))
    changes = S.paired_decisions(decided, kernel_pairs(test.select(*ids)))
    paired, paired_scans = S.paired_by_label(changes), S.paired_by_scan(changes)
    gaps = S.kernel_gap(per_label)
    gates = S.gate(per_label.filter("group_by = 'all'"), gaps, paired, **settings.gate)
    return {"parameters": C.parameter_table(params, points, ["report", "ruleout", "max_f1", *fixed]), "per_label": per_label,
            "summary": summary, "per_scan": scans, "paired": paired, "paired_scans": paired_scans,
            "paired_summary": S.paired_summary(paired_scans), "gate": gates, "kernel_gap": gaps,
            "predictions": S.calibrated_wide(decided, ids, labels)}


def ensemble_report(spark: SparkSession, members: DataFrame, status: DataFrame, evaluation: str, settings: ReportSettings = ReportSettings(), *,
                    per_seed: bool = False, seed: int = 0) -> dict[str, dict[str, DataFrame]]:
    """The report of the mean prediction of all finished members with this evaluation, under ``ensemble``; with ``per_seed``, one of each member too.

    An ensemble without such a member is an error. The members are the few seeds of one configuration; their names alone come to the driver.
    """
    kept = finished_members(members, status, evaluation)
    names = [r.member for r in kept.select("member").distinct().orderBy("member").collect()]
    if not names:
        raise ValueError(f"no finished member has the evaluation {evaluation!r}")
    labels = label_names(members)
    ids = [c for c in members.columns if c not in ("member", "eval") and not c.startswith(("prob_", "true_"))]

    def report(rows: DataFrame) -> dict[str, DataFrame]:
        return score(spark, rows.filter("split = 'val'"), rows.filter("split = 'test'"), settings, seed)
    out = {str(n): report(kept.filter(F.col("member") == n).drop("member", "eval")) for n in names} if per_seed else {}
    return {**out, "ensemble": report(average_members(kept, labels, ids))}


def _macro_name(metric: str) -> str:
    rule, _, kind = metric.partition("_")
    return f"{rule}_macro_{kind}" if rule in ("report", "maxf1") else f"macro_{metric}"


def headline(parts: dict[str, DataFrame]) -> DataFrame:
    """One wide row: overall numbers, gate counts, per-kernel numbers, paired numbers."""
    per_kernel = ("report_macro_sens", "report_fp_per_scan", "macro_ece_raw", "macro_ece", "macro_auroc")
    overall_columns = [c for c in parts["summary"].columns if c not in ("group_by", "group", "too_small")]
    whole = (F.col("group_by") == "all")
    aggs = [F.max(F.when(whole, F.col(c))).alias(c) for c in overall_columns]
    aggs += [F.max(F.when((F.col("group_by") == "kernel_class") & (F.col("group") == k), F.col(c))).alias(f"{c}[{k}]")
             for k in S.PAIR_KERNELS for c in per_kernel]
    gates = parts["gate"].agg(*[F.count_if(F.col("status") == s).cast("bigint").alias(f"labels_{s}")
                                for s in ("supported", "review", "not_supported")])
    gap = parts["kernel_gap"].agg(F.avg(F.abs("kernel_sens_gap")).alias("kernel_sens_gap_mean_abs"))
    rows = parts["summary"].agg(*aggs)
    for one in (gates, gap, parts["paired_summary"]):
        rows = rows.unionByName(one, allowMissingColumns=True)
    return rows.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in rows.columns])
