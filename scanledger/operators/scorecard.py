"""What a reader of the output meets: decisions per label, per scan and per pair, and the per-label gate.

Input is the long prediction frame with calibrated probability ``p``, label ``y`` (NULL = unknown) and the
operating points of its label (columns ``report, ruleout, max_f1, spec*``).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import count_if, ratio
from .predictions import PAIR_KERNELS, by_group

RULES = ("report", "maxf1")


def decide(long: DataFrame, points: DataFrame) -> DataFrame:
    """Adds the label's operating points, the three-way ``state`` and the max-F1 flag.

    ``points`` has one row per label; a label without thresholds is uncertain everywhere. Absent wins.
    """
    joined = long.join(points, "label", "left")
    state = F.when(F.col("p") < F.col("ruleout"), "absent").when(F.col("p") >= F.col("report"), "present").otherwise("uncertain")
    return joined.withColumn("state", state).withColumn("flag_f1", F.coalesce(F.col("p") >= F.col("max_f1"), F.lit(False)))


def label_blocks(long: DataFrame, group_columns: Sequence[str], scores: Sequence[str] = ("p",)) -> DataFrame:
    """The one pass over predictions that per-label numbers need: distinct scores with counts.

    State, flag, bin and error of a volume depend on its label, score and group only, so volumes with equal ones are
    counted together before anything else happens.
    """
    known = long.filter(F.col("y").isNotNull())
    return known.groupBy("label", *group_columns, *scores).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum("y").cast("bigint").alias("n_pos"))


def spread(blocks: DataFrame, group_columns: Sequence[str]) -> DataFrame:
    """Blocks once per group they belong to, counted together per (group, label, score)."""
    scores = [c for c in blocks.columns if c not in ("label", "n", "n_pos", *group_columns)]
    rows = by_group(blocks, group_columns, ["label", *scores, "n", "n_pos"])
    return rows.groupBy("group_by", "group", "label", *scores).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


KEYS = ["group_by", "group", "label"]


def confusion_sums(rules: dict[str, Column]) -> list[Column]:
    """tp / fp / fn / tn of every rule over blocks."""
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")

    def total(flag: Column, count: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, count)), F.lit(0)).cast("bigint")
    out = []
    for name, flag in rules.items():
        out += [total(flag, pos).alias(f"{name}_tp"), total(flag, neg).alias(f"{name}_fp"),
                total(~flag, pos).alias(f"{name}_fn"), total(~flag, neg).alias(f"{name}_tn")]
    return out


def rate(name: str, kind: str) -> Column:
    tp, fp, fn, tn = (F.col(f"{name}_{k}") for k in ("tp", "fp", "fn", "tn"))
    return {"sens": ratio(tp, tp + fn), "spec": ratio(tn, tn + fp), "ppv": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn)}[kind]


def decision_rules(fixed: Sequence[str] = ()) -> dict[str, Column]:
    rules = {"report": F.col("state") == "present", "ruleout": F.col("state") != "absent", "maxf1": F.col("flag_f1")}
    return rules | {s: F.coalesce(F.col("p") >= F.col(s), F.lit(False)) for s in fixed}


def grouped_rates(decided: DataFrame, rules: dict[str, Column], kinds: Sequence[str] = ("sens", "spec", "ppv", "npv"),
                  more: Sequence[Column] = (), finish: dict[str, Column] | None = None) -> DataFrame:
    """Rates of each rule per group and label from decided blocks; ``more`` sums ride along in the same aggregate."""
    counts = decided.groupBy(*KEYS).agg(
        F.sum("n").cast("bigint").alias("all_n"), F.sum("n_pos").cast("bigint").alias("all_pos"),
        F.coalesce(F.sum(F.when(F.col("state") == "uncertain", F.col("n"))), F.lit(0)).alias("n_uncertain"), *confusion_sums(rules), *more)
    return counts.select(*KEYS, F.col("all_n").alias("n"), F.col("all_pos").alias("n_pos"), ratio(F.col("all_pos"), F.col("all_n")).alias("prevalence"),
                         ratio(F.col("n_uncertain"), F.col("all_n")).alias("uncertain_rate"),
                         *[rate(r, k).alias(f"{r}_{k}") for r in rules for k in kinds], *[c.alias(k) for k, c in (finish or {}).items()])


def thresholded(blocks: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, F1, sensitivity, specificity and PPV at each label's threshold (positive when p >= t)."""
    scored = blocks.join(thresholds.select("label", "threshold"), "label")
    flag = F.coalesce(F.col("p") >= F.col("threshold"), F.lit(False))
    counts = scored.groupBy(*keys).agg(F.max("threshold").alias("threshold"), *confusion_sums({"at": flag}))

    def known(c: Column) -> Column:
        return F.when(F.col("threshold").isNotNull(), c)
    return counts.select(*keys, "threshold", *[F.col(f"at_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")],
                         known(rate("at", "f1")).alias("f1"), known(rate("at", "sens")).alias("sensitivity"),
                         known(rate("at", "spec")).alias("specificity"), known(rate("at", "ppv")).alias("ppv"))


def bins_of(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")


def calibration_error(grouped: DataFrame, score: str = "p", bins: int = 10, name: str = "ece") -> DataFrame:
    """Expected calibration error per group and label over equal-width bins, from grouped blocks."""
    per_bin = grouped.groupBy(*KEYS, bins_of(F.col(score), bins).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("sy"), F.sum(F.col("n") * F.col(score)).alias("sp"))
    return per_bin.groupBy(*KEYS).agg(ratio(F.sum(F.abs(F.col("sy") - F.col("sp"))), F.sum("n")).alias(name))


def squared_error() -> Column:
    """Sum of squared errors over blocks."""
    p = F.col("p")
    return F.sum(F.col("n_pos") * (F.lit(1.0) - p) * (F.lit(1.0) - p) + (F.col("n") - F.col("n_pos")) * p * p)


def brier(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy(*KEYS).agg(ratio(squared_error(), F.sum("n")).alias("brier"))


def net_benefit_sums(cuts: Sequence[float]) -> list[Column]:
    """Sum of true minus weighted false positives at every threshold probability."""
    out = []
    for i, c in enumerate(cuts):
        gain = F.col("n_pos") - F.lit(float(c)) / (F.lit(1.0) - F.lit(float(c))) * (F.col("n") - F.col("n_pos"))
        out.append(F.sum(F.when(F.col("p") >= F.lit(float(c)), gain).otherwise(0.0)).alias(f"_nb{i}"))
    return out


def net_benefit(grouped: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Net benefit of the model and of flagging everyone, per threshold probability: one aggregate for all of them."""
    sums = grouped.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("pos"), *net_benefit_sums(cuts))
    rows = F.array(*[F.struct(F.lit(float(c)).alias("pt"), F.col(f"_nb{i}").alias("gain")) for i, c in enumerate(cuts)])
    prev = ratio(F.col("pos"), F.col("n"))
    long = sums.select(*KEYS, "n", prev.alias("prev"), F.inline(rows))
    odds = F.col("pt") / (F.lit(1.0) - F.col("pt"))
    return long.select(*KEYS, "pt", ratio(F.col("gain"), F.col("n")).alias("net_benefit"),
                       (F.col("prev") - odds * (F.lit(1.0) - F.col("prev"))).alias("net_benefit_all"))


def per_label_table(decided: DataFrame, fixed: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """Rates of all rules, Brier score and net benefits per group and label in one aggregate over decided blocks."""
    def odds(c: float) -> Column:
        return F.lit(float(c)) / (F.lit(1.0) - F.lit(float(c)))
    prev = ratio(F.col("all_pos"), F.col("all_n"))
    finish: dict[str, Column] = {"brier": ratio(F.col("_sq"), F.col("all_n"))}
    for i, c in enumerate(cuts):
        finish[f"net_benefit@{c:g}"] = ratio(F.col(f"_nb{i}"), F.col("all_n"))
        finish[f"net_benefit_all@{c:g}"] = prev - odds(c) * (F.lit(1.0) - prev)
    return grouped_rates(decided, decision_rules(fixed), more=[squared_error().alias("_sq"), *net_benefit_sums(cuts)], finish=finish)


def per_scan(decided: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per volume: labels known, true, flagged, right and wrong under each rule."""
    known, pos, neg = F.col("y").isNotNull(), F.col("y") == 1, F.col("y") == 0
    aggs = [F.count("y").cast("bigint").alias("n_known"), count_if(pos).alias("n_true")]
    for rule, flag in (("report", F.col("state") == "present"), ("maxf1", F.col("flag_f1"))):
        aggs += [count_if(known & flag).alias(f"{rule}_pred"), count_if(pos & flag).alias(f"{rule}_tp"),
                 count_if(neg & flag).alias(f"{rule}_fp"), count_if(pos & ~flag).alias(f"{rule}_fn"),
                 F.bool_and(~known | (flag == pos)).alias(f"{rule}_exact")]
    aggs.append(count_if(known & (F.col("state") == "uncertain")).alias("n_uncertain"))
    return decided.groupBy(*ids).agg(*aggs)


def scan_summary(scans: DataFrame, group_columns: Sequence[str], min_group: int = 100) -> DataFrame:
    """Per group: means per scan, share of scans with a false label, exact matches, normal scans flagged."""
    normal = F.col("n_true") == 0
    sums: dict[str, Column] = {"n_volumes": F.count(F.lit(1)), "n_normal": F.count_if(normal), "true": F.sum("n_true"),
                               "unc": F.sum("n_uncertain"), "unc_any": F.count_if(F.col("n_uncertain") > 0)}
    for r in RULES:
        sums |= {f"{r}_{k}": F.sum(f"{r}_{k}") for k in ("pred", "tp", "fp", "fn")}
        sums |= {f"{r}_any": F.count_if(F.col(f"{r}_fp") > 0), f"{r}_hit": F.count_if(F.col(f"{r}_exact")),
                 f"{r}_flag": F.count_if(normal & (F.col(f"{r}_pred") > 0))}
    base = scans.groupBy("patient_id", *group_columns).agg(*[c.alias(n) for n, c in sums.items()])
    spread = by_group(base, group_columns, ["patient_id", *sums]).groupBy("group_by", "group", "patient_id").agg(
        *[F.sum(n).alias(n) for n in sums])
    total = spread.groupBy("group_by", "group").agg(F.count(F.lit(1)).cast("bigint").alias("n_patients"), *[F.sum(n).alias(n) for n in sums])

    def mean(name: str) -> Column:
        return ratio(F.col(name), F.col("n_volumes"))
    out = ["group_by", "group", (F.col("n_volumes") < min_group).alias("too_small"), "n_patients", F.col("n_volumes").cast("bigint").alias("n_volumes"),
           F.col("n_normal").cast("bigint").alias("n_normal"), mean("true").alias("true_per_scan")]
    for r in RULES:
        out += [mean(f"{r}_{k}").alias(f"{r}_{k}_per_scan") for k in ("pred", "tp", "fp", "fn")]
        out += [mean(f"{r}_any").alias(f"{r}_scans_with_fp"), mean(f"{r}_hit").alias(f"{r}_exact_match"),
                ratio(F.col(f"{r}_flag"), F.col("n_normal")).alias(f"{r}_normal_flag_rate")]
    return total.select(*out, mean("unc").alias("uncertain_per_scan"), mean("unc_any").alias("scans_with_uncertain"))


def paired_decisions(decided: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (pair, label): whether the decision, the state and the max-F1 flag differ, and the shift of p.

    The two sides meet by an aggregation over the scan, so the predictions are shuffled once.
    """
    sides = pairs.select("scan", F.explode(F.array(
        *[F.struct(F.col(f"{k}_volume").alias("volume_id"), F.lit(k).alias("side")) for k in PAIR_KERNELS])).alias("v")).select("scan", "v.*")
    rows = decided.select("volume_id", "label", "p", "state", "flag_f1").join(sides, "volume_id")
    wide = rows.groupBy("scan", "label").agg(*[
        F.max(F.when(F.col("side") == k, F.struct("volume_id", "p", "state", "flag_f1"))).alias(k) for k in PAIR_KERNELS])
    a, b = "sharp", "soft"
    present = [F.col(f"{k}.state") == "present" for k in (a, b)]
    absent = [F.col(f"{k}.state") == "absent" for k in (a, b)]
    return wide.select(
        "scan", "label", F.col("sharp.volume_id").alias("sharp_volume"), F.col("soft.volume_id").alias("soft_volume"),
        (present[0] != present[1]).cast("bigint").alias("flip"), (F.col("sharp.flag_f1") != F.col("soft.flag_f1")).cast("bigint").alias("maxf1_flip"),
        (F.col("sharp.state") != F.col("soft.state")).cast("bigint").alias("state_change"),
        ((present[0] & absent[1]) | (absent[0] & present[1])).cast("bigint").alias("hard"), (F.col("soft.p") - F.col("sharp.p")).alias("dp"))


def paired_by_label(changes: DataFrame) -> DataFrame:
    def mean(c: str) -> Column:
        return ratio(F.sum(c), F.count(F.lit(1)))
    return changes.groupBy("label").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pairs"), mean("flip").alias("flip_rate"), mean("maxf1_flip").alias("maxf1_flip_rate"),
        mean("state_change").alias("state_change_rate"), mean("hard").alias("hard_contradiction_rate"),
        F.avg(F.abs("dp")).alias("mean_abs_dp"), F.avg("dp").alias("mean_dp_soft_minus_sharp"))


def paired_by_scan(changes: DataFrame) -> DataFrame:
    return changes.groupBy("scan", "sharp_volume", "soft_volume").agg(
        F.sum("flip").cast("bigint").alias("flips"), F.sum("maxf1_flip").cast("bigint").alias("maxf1_flips"),
        F.sum("state_change").cast("bigint").alias("state_changes"), F.sum("hard").cast("bigint").alias("hard_contradictions"))


def paired_summary(scans: DataFrame) -> DataFrame:
    """One row of means over the pairs; no pairs give n_pairs = 0 and NULLs."""
    n = F.count(F.lit(1))

    def share(c: str) -> Column:
        return ratio(F.count_if(F.col(c) > 0), n)

    def mean(c: str) -> Column:
        return F.avg(F.col(c).cast("double"))
    return scans.agg(
        n.cast("bigint").alias("n_pairs"), share("flips").alias("paired_scans_with_flip"), mean("flips").alias("paired_flips_per_scan"),
        share("maxf1_flips").alias("paired_maxf1_scans_with_flip"), mean("maxf1_flips").alias("paired_maxf1_flips_per_scan"),
        mean("state_changes").alias("paired_state_changes_per_scan"), share("hard_contradictions").alias("paired_scans_with_hard_contradiction"),
        mean("hard_contradictions").alias("paired_hard_contradictions_per_scan"))


def kernel_gap(per_label: DataFrame, metric: str = "report_sens") -> DataFrame:
    """Soft minus sharp of a per-label metric."""
    def of(kernel: str) -> Column:
        return F.max(F.when(F.col("group") == kernel, F.col(metric)))
    return per_label.filter("group_by = 'kernel_class'").groupBy("label").agg((of("soft") - of("sharp")).alias("kernel_sens_gap"))


def gate(labels: DataFrame, gaps: DataFrame, paired: DataFrame, *, auroc_ci_low=0.80, report_sensitivity=0.60, ece=0.05,
         paired_flip_rate=0.10, kernel_sensitivity_gap=0.10) -> DataFrame:
    """Per label: five rules (NULL = not applicable) and supported / review / not_supported."""
    t = labels.select("label", "auroc_ci_low", "report_sens", "ece").join(
        paired.select("label", F.col("flip_rate").alias("paired_flip_rate")), "label", "left").join(gaps, "label", "left")
    t = (t.withColumn("pass_auroc", F.col("auroc_ci_low") >= auroc_ci_low).withColumn("pass_sens", F.col("report_sens") >= report_sensitivity)
         .withColumn("pass_ece", F.col("ece") <= ece).withColumn("pass_flip", F.col("paired_flip_rate") <= paired_flip_rate)
         .withColumn("pass_kernel_gap", F.abs("kernel_sens_gap") <= kernel_sensitivity_gap))

    def ok(*rules: str) -> Column:
        out = F.lit(True)
        for r in rules:
            out = out & F.coalesce(F.col(r), F.lit(True))
        return out
    return t.withColumn("status", F.when(~ok("pass_auroc", "pass_sens"), "not_supported")
                        .when(~ok("pass_ece", "pass_flip", "pass_kernel_gap"), "review").otherwise("supported"))


def reliability_curve(long: DataFrame, bins: int = 10, min_rows: int = 20) -> DataFrame:
    """Mean probability against observed frequency per kernel class and bin, labels pooled."""
    rows = long.filter(F.col("y").isNotNull() & F.col("kernel_class").isin(*PAIR_KERNELS))
    return rows.groupBy("kernel_class", bins_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y")).filter(F.col("n") > min_rows)


def false_label_distribution(scans: DataFrame, rule: str = "report") -> DataFrame:
    """Share of scans by number of false labels."""
    counts = scans.groupBy(F.col(f"{rule}_fp").alias("false_labels")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    n = scans.agg(F.count(F.lit(1))).scalar()
    return counts.select("false_labels", "n", ratio(F.col("n"), n).alias("share"))


def calibrated_wide(decided: DataFrame, ids: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``cal_<label>``, ``state_<label>``, ``true_<label>`` per volume."""
    from .predictions import to_wide
    return to_wide(decided, ids, {"cal_": "p", "state_": "state", "true_": "y"}, labels)


def newest_reports(reports: DataFrame) -> DataFrame:
    """The latest report per (run, evaluation)."""
    from .ordering import first_per
    return first_per(reports, ["run_id", "eval"], ["reported"], descending=True)
