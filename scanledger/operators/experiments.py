"""Experiment tables: settings, curves, ledgers, comparison of configurations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ids import eval_key, metric_key
from ..functions.numeric import finite, mean_std_text, ratio
from .ordering import number_cell, positions, prefix_sums

# fixed values: names and places of a run, which are no settings of its experiment
NOT_A_SETTING = ("name", "seed", "device", "output_dir", "data_config", "encode_config")
# fixed value: longest parameter text of a tracking service
MAX_PARAM = 500


def attach_status(table: DataFrame, status: DataFrame) -> DataFrame:
    """Per-label table with the gate status of its label."""
    return table.join(status.select("label", "status"), "label", "left")


def combined_hash(parts: DataFrame, key: str) -> DataFrame:
    """sha256 over the ``name:hash`` lines of a combination's parts, in part order.

    A combination is a handful of runs named in one setting, so its parts fit one row.
    """
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(":", "name", "hash").alias("line"))))
    return parts.groupBy(key).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("combined"))


def flatten_settings(configs: DataFrame, key: str, json: str, depth: int = 5) -> DataFrame:
    """Nested JSON settings as (key, setting, value) rows with dotted names; lists stay text."""
    as_map = "map<string,string>"
    level = configs.select(key, F.explode(F.from_json(F.col(json), as_map)).alias("setting", "value"))
    nested = F.col("value").startswith("{")
    out = level.filter(~F.coalesce(nested, F.lit(False)))
    for _ in range(depth - 1):
        level = level.filter(nested).select(key, "setting", F.explode(F.from_json("value", as_map)).alias("_k", "value")).select(
            key, F.concat_ws(".", "setting", "_k").alias("setting"), "value")
        out = out.unionByName(level.filter(~F.coalesce(nested, F.lit(False))))
    return out


def varying_settings(settings: DataFrame, key: str = "config") -> DataFrame:
    """Settings with more than one value over the configurations, and the most common value (the smallest among equals)."""
    used = settings.filter(~F.col("setting").isin(*NOT_A_SETTING) & F.col("value").isNotNull())
    counts = used.groupBy("setting", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("setting").agg(F.count(F.lit(1)).cast("bigint").alias("n_values"),
                                         F.min(F.struct((-F.col("n")).alias("n"), "value")).getField("value").alias("common")).filter("n_values > 1")


def setup_labels(settings: DataFrame, key: str = "config") -> DataFrame:
    """``k=v, ...`` of the settings where a configuration departs from the most common value, else ``reference``."""
    varying = varying_settings(settings, key).select("setting", "common")
    departs = settings.join(varying, "setting").filter(F.col("value") != F.col("common"))
    short = F.element_at(F.split("setting", r"\."), -1)
    text = departs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("setting", F.concat_ws("=", short, F.col("value")).alias("t")))),
                                                             lambda s: s["t"]), ", ").alias("setup"))
    return settings.select(key).distinct().join(text, key, "left").select(key, F.coalesce("setup", F.lit("reference")).alias("setup"))


def mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Rows, mean and sample std of every metric per key; NULL keys form a group of their own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("seeds"), *[c for m in metrics for c in (
        F.avg(m).alias(m), F.when(F.count(m) > 1, F.stddev_samp(m)).alias(f"{m}_std"))])


def mean_std_texts(table: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 4) -> DataFrame:
    return table.select(*keys, "seeds", *[mean_std_text(F.col(m), F.col(f"{m}_std"), digits).alias(m) for m in metrics])


def join_ledgers(evaluations: DataFrame, runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Evaluations with columns of their run; the ledger holds one row per run."""
    return evaluations.join(runs.select("run_id", *columns), "run_id", "left")


def ledger_summary(ledger: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("name", "config_hash", "aggregator", "loss", "lr"), name: str | None = None) -> DataFrame:
    """Mean and std of the metrics over the seeds of every configuration."""
    keys = [k for k in keys if k in ledger.columns]
    rows = ledger.filter(F.col("name") == name) if name else ledger
    return mean_std(rows, keys, metrics)


def metric_pivot(metrics: DataFrame, keys: Sequence[str], metric: str = "macro_auroc") -> DataFrame:
    """Per run: the overall, sharp and soft value of a metric and soft minus sharp. Input has group_by and group."""
    def pick(by: str, group: str) -> Column:
        return F.max(F.when((F.col("group_by") == by) & (F.col("group") == group), F.col(metric)))
    wide = metrics.groupBy(*keys).agg(pick("all", "all").alias("overall"), pick("kernel_class", "sharp").alias("sharp"), pick("kernel_class", "soft").alias("soft"))
    return wide.withColumn("soft_minus_sharp", F.col("soft") - F.col("sharp"))


def pivot_over_seeds(pivot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and sample std of the pivoted values over the runs of a configuration."""
    return mean_std(pivot, keys, ["overall", "sharp", "soft", "soft_minus_sharp"])


def metric_by_scanner(metrics: DataFrame, keys: Sequence[str], metric: str = "macro_auroc") -> DataFrame:
    """Mean and sample std of a metric per configuration and manufacturer, over the runs."""
    rows = metrics.filter("group_by = 'manufacturer'").withColumnRenamed("group", "manufacturer")
    return mean_std(rows, [*keys, "manufacturer"], [metric])


def delta_to_reference(table: DataFrame, key: str, reference, metrics: Sequence[str]) -> DataFrame:
    """Metrics minus those of the reference configuration, in hundredths."""
    ref = table.filter(F.col(key) == reference)
    return table.select(key, *[((F.col(m) - ref.agg(F.max(m)).scalar()) * 100).alias(f"delta_{m}") for m in metrics])


def findings_beating_reference(per_label: DataFrame, key: str, reference, metric: str = "auroc") -> DataFrame:
    """Per configuration: labels scored better than by the reference, and labels compared."""
    ref = per_label.filter(F.col(key) == reference).select("label", F.col(metric).alias("_ref"))
    better = F.count_if(F.col(metric) > F.col("_ref"))
    return per_label.filter(F.col(key) != reference).join(ref, "label").groupBy(key).agg(
        better.cast("bigint").alias("better"), F.count(F.when(F.col(metric).isNotNull() & F.col("_ref").isNotNull(), F.lit(1))).cast("bigint").alias("compared"))


def phase_gate(reports: DataFrame, key: str, baseline) -> DataFrame:
    """Four targets of every configuration against the baseline's report."""
    base = reports.filter(F.col(key) == baseline)

    def of(c: str) -> Column:
        return base.agg(F.max(c)).scalar()
    gap = F.col("sens_soft") - F.col("sens_sharp")
    return reports.select(key, (F.col("paired_flip") <= of("paired_flip") / 2).alias("flip_halved"), (F.abs(gap) <= 0.05).alias("gap_small"),
                          (F.col("fp_per_scan") <= of("fp_per_scan") + F.lit(1e-9)).alias("fp_not_worse"), (F.col("supported") > of("supported")).alias("more_supported"),
                          gap.alias("sens_gap"))


def relative_curves(curves: DataFrame) -> DataFrame:
    """Validation loss over its run minimum, training loss over its first epoch."""
    base = curves.groupBy("run_id").agg(F.min("val_loss").alias("_low"), F.min_by("train_loss", "epoch").alias("_first"))
    return curves.join(base, "run_id").select("run_id", "epoch", ratio(F.col("val_loss"), F.col("_low")).alias("val_loss_rel"),
                                              ratio(F.col("train_loss"), F.col("_first")).alias("train_loss_rel"))


def run_ends(curves: DataFrame, max_epochs: int) -> DataFrame:
    """Per run: epochs, best epoch, late-best flag, learning rate left at the stop in percent, seconds per epoch."""
    out = curves.groupBy("run_id").agg(F.max("epoch").cast("bigint").alias("epochs_run"), F.min(F.struct("val_loss", "epoch")).getField("epoch").alias("best_epoch"),
                                       (F.max_by("lr", "epoch") / F.max("lr") * 100).alias("lr_left"), F.avg("seconds").alias("seconds_per_epoch"))
    return out.withColumn("late_best", F.col("best_epoch") > F.lit(0.9) * max_epochs)


def replay_early_stopping(curves: DataFrame, metric: str, patience: int, lower_is_better: bool = False) -> DataFrame:
    """Per epoch up to the stop: best value before it, whether it improved, epochs since the last improvement.

    A missing or NaN value never improves. A run has at most max_epochs rows, so the window is small.
    """
    value = F.when(~F.isnan(F.col(metric).cast("double")), F.col(metric).cast("double"))
    run = W.partitionBy("run_id").orderBy("epoch")
    before = run.rowsBetween(W.unboundedPreceding, -1)
    best = (F.min(value) if lower_is_better else F.max(value)).over(before)
    rows = curves.select("run_id", "epoch", value.alias("value"), best.alias("best_before"), F.row_number().over(run).alias("_i"))
    rows = rows.withColumn("improved", F.when(F.col("value").isNull(), False).when(F.col("best_before").isNull(), True).otherwise(
        (F.col("value") < F.col("best_before")) if lower_is_better else (F.col("value") > F.col("best_before"))))
    last = F.max(F.when(F.col("improved"), F.col("_i"))).over(run.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("bad_epochs", (F.col("_i") - F.coalesce(last, F.lit(0))).cast("bigint"))
    stopped = F.coalesce(F.max(F.when(F.col("bad_epochs") >= patience, 1)).over(before), F.lit(0))
    return rows.withColumn("_over", stopped).filter("_over = 0").select("run_id", "epoch", "value", "best_before", "improved", "bad_epochs")


def early_stops(replayed: DataFrame, patience: int) -> DataFrame:
    """Per run: epochs run, best epoch and value, and why it ended."""
    return replayed.groupBy("run_id").agg(
        F.max("epoch").cast("bigint").alias("epochs_run"), F.max(F.when(F.col("improved"), F.col("epoch"))).cast("bigint").alias("best_epoch"),
        F.max_by(F.when(F.col("improved"), F.col("value")), F.when(F.col("improved"), F.col("epoch"))).alias("best_value"),
        F.when(F.max("bad_epochs") >= patience, "early_stopping").otherwise("max_epochs").alias("stopped"))


def failure_streaks(log: DataFrame, order: str, limit: int) -> DataFrame:
    """Length of the current run of failures at every failed chunk, in log order; a success ends it.

    ``log`` has chunk, failed and a unique numeric ``order``. Failures after the same number of successes form one
    streak; both counts are cell-wise prefix sums, so a long log is never sorted in one task.
    """
    counted = prefix_sums(log.select("chunk", "failed", order, F.when(F.col("failed"), 0).otherwise(1).alias("_ok")), [], number_cell(F.col(order)), [order], ["_ok"])
    failures = counted.filter("failed").select("chunk", order, F.col("_ok_before").alias("_island"))
    ranked = positions(failures, ["_island"], number_cell(F.col(order)), [order], "_p")
    return ranked.select("chunk", order, (F.col("_p") + 1).alias("streak"), (F.col("_p") + 1 >= limit).alias("alert"))


def typical_run(runs: DataFrame, key: str, metric: str) -> DataFrame:
    """The run closest to its configuration's mean."""
    mean = runs.groupBy(key).agg(F.avg(metric).alias("mean"))
    gap = F.abs(F.col(metric) - F.col("mean"))
    return runs.join(mean, key).groupBy(key).agg(F.min(F.struct(F.round(gap, 12).alias("gap"), "run_id")).getField("run_id").alias("run_id"), F.max("mean").alias("mean"))


def ranked_configs(runs: DataFrame, key: str, metric: str) -> DataFrame:
    """Configurations with their mean, best first."""
    return runs.groupBy(key).agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).cast("bigint").alias("runs")).orderBy(F.col("mean").desc_nulls_last(), key)


def export_curves(curves: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Curve metrics as (run_id, key, value, step); values that are not finite are left out."""
    rows = F.array(*[F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics])
    return curves.select("run_id", F.col("epoch").cast("bigint").alias("step"), F.inline(rows)).filter(finite(F.col("value"))).select("run_id", "key", "value", "step")


def export_params(settings: DataFrame, key: str = "run_id") -> DataFrame:
    """Flattened settings of a run as (run, key, value) texts; the run's name and folder are left out, NULL is ``null``.

    A value is cut to the length that a tracking service takes.
    """
    return settings.filter(~F.col("setting").isin("name", "output_dir")).select(
        key, metric_key(F.col("setting")).alias("key"), F.substring(F.coalesce("value", F.lit("null")), 1, MAX_PARAM).alias("value"))


def export_summary(summary: DataFrame, metrics: Sequence[str], train_source: str = "source", train_run: str = "run") -> DataFrame:
    """Evaluation metrics as long rows: ``<split>.<metric>``, with the group's name for a subgroup."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    group = F.when(F.col("group_by") == "all", F.lit("")).otherwise(F.col("group"))
    split = eval_key(F.col("eval"), F.col(train_source), F.col(train_run))
    return summary.select("run_id", split.alias("_s"), group.alias("_g"), F.inline(rows)).filter(finite(F.col("value"))).select(
        "run_id", metric_key(F.col("_s"), F.col("metric"), F.col("_g")).alias("key"), "value", F.lit(0).cast("bigint").alias("step"))


def export_labels(per_label: DataFrame, metrics: Sequence[str] = ("auroc", "auprc"), train_source: str = "source", train_run: str = "run") -> DataFrame:
    """Per-label metrics of the whole set as ``<split>.label.<label>.<metric>``."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    split = eval_key(F.col("eval"), F.col(train_source), F.col(train_run))
    return per_label.filter("group_by = 'all'").select("run_id", split.alias("_s"), "label", F.inline(rows)).filter(finite(F.col("value"))).select(
        "run_id", metric_key(F.col("_s"), F.lit("label"), F.col("label"), F.col("metric")).alias("key"), "value", F.lit(0).cast("bigint").alias("step"))
