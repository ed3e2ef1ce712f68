"""Experiment folders and clinical reports as tables, found by file name below one root.

A root may hold very many small files: they are listed and opened by tasks (``raw.list_files``), so that no list of them passes through the
driver. Readers that need several kinds of file share one listing (``files``).
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .raw import csv_rows, list_files, texts

RUN_INFO = ("run_id string, config_hash string, status string, started string, ended string, stopped string, best_epoch bigint, epochs_run bigint, "
            "steps_per_epoch bigint, git struct<commit:string,dirty:boolean>")
SCORECARD = ("run_id string, name string, config_hash string, seed string, members bigint, eval string, reported string, clinical_config_fingerprint string, "
             "headline map<string,double>")


def _find(spark: SparkSession, root: str, name: str, files: DataFrame | None) -> DataFrame:
    files = list_files(spark, root) if files is None else files
    # a short list of names stands for files that take far longer to open
    return files.filter(F.col("name") == name).select("dir", "name").repartition(4 * spark.sparkContext.defaultParallelism)


def read_json_files(spark: SparkSession, root: str, name: str, schema: str, files: DataFrame | None = None) -> DataFrame:
    """One row per file of that name with the folder it lies in, or one per element where the document is a list; broken ones have NULLs."""
    raw = _find(spark, root, name, files).mapInArrow(texts, "dir string, value string")
    listed = F.from_json("value", T.ArrayType(T.StructType.fromDDL(schema)))
    one = F.array(F.from_json("value", T.StructType.fromDDL(schema)))
    docs = raw.select("dir", F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(one)).alias("doc"))
    return docs.select("dir", "doc.*")


def read_csv_files(spark: SparkSession, root: str, name: str, schema: str, files: DataFrame | None = None) -> DataFrame:
    """Rows of all CSV files of that name with their folder; ``schema`` names the wanted columns, matched by header. Cells that do not fit are NULL."""
    fields = T.StructType.fromDDL(schema).fields
    text = T.StructType([T.StructField(n, T.StringType()) for n in ("dir", *[f.name for f in fields])])
    rows = _find(spark, root, name, files).mapInArrow(csv_rows([f.name for f in fields]), text)
    return rows.select("dir", *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def read_configs(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Config files as JSON text; YAML is converted file by file in Arrow batches."""
    @F.pandas_udf("string")
    def as_json(text: pd.Series) -> pd.Series:
        import json
        import yaml
        return text.map(lambda t: json.dumps(yaml.safe_load(t) or {}, default=str))

    raw = _find(spark, root, "config.yaml", files).mapInArrow(texts, "dir string, value string")
    return raw.select("dir", as_json("value").alias("config"))


def _beside(rows: DataFrame, others: DataFrame, on: str | list[str] = "dir", how: str = "inner") -> DataFrame:
    """Join of opened files. Spark knows the size of the list of names only and takes what is read from the files for as little, so without the
    hint it would broadcast any number of their rows through the driver."""
    return rows.hint("merge").join(others, on, how)


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every folder that has both a config and a run record: ids, settings of note, status and validation metrics."""
    files = list_files(spark, root)
    info = read_json_files(spark, root, "run_info.json", RUN_INFO, files)
    metrics = read_json_files(spark, root, "val_metrics.json", "macro_auroc double, macro_auprc double, micro_auroc double, macro_f1 double", files)
    metrics = metrics.select("dir", *[F.col(c).alias(f"val_{c}") for c in metrics.columns if c != "dir"])

    def setting(path: str) -> Column:
        return F.get_json_object("config", f"$.{path}")
    return (_beside(_beside(info, read_configs(spark, root, files)), metrics, how="left").select(
        F.coalesce("run_id", "dir").alias("run_id"), setting("name").alias("name"), "config_hash", F.substring("config_hash", 1, 8).alias("hash8"),
        setting("seed").cast("bigint").alias("seed"), F.coalesce("status", F.lit("unknown")).alias("status"), "stopped", "best_epoch", "epochs_run",
        setting("optim.max_epochs").cast("bigint").alias("max_epochs"), "val_macro_auroc", "val_macro_auprc", "val_micro_auroc", "val_macro_f1", "config", "dir"))


def load_curves(spark: SparkSession, root: str, schema: str) -> DataFrame:
    files = list_files(spark, root)
    return _beside(read_csv_files(spark, root, "metrics.csv", schema, files), load_ids(spark, root, files))


def load_ids(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    return read_json_files(spark, root, "run_info.json", RUN_INFO, files).select("dir", F.coalesce("run_id", "dir").alias("run_id"), "config_hash")


def load_evaluations(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of ``eval/<source>__<run>__<split>/<name>`` with the evaluation's name, its split and the run."""
    files = list_files(spark, root)
    rows = read_csv_files(spark, root, name, schema, files)
    parts = F.split(F.regexp_extract("dir", r"/eval/([^/]+)$", 1), "__")
    named = rows.filter(F.col("dir").rlike("/eval/[^/]+$")).select(
        F.regexp_extract("dir", r"/eval/([^/]+)$", 1).alias("eval"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("eval_split"),
        F.regexp_replace("dir", "/eval/[^/]+$", "").alias("dir"), *[c for c in rows.columns if c != "dir"])
    return _beside(named, load_ids(spark, root, files))


def load_clinical(spark: SparkSession, root: str, per_label_schema: str) -> tuple[DataFrame, DataFrame]:
    """(one row per clinical report, its per-label rows with the gate status)."""
    files = list_files(spark, root)
    cards = read_json_files(spark, root, "scorecard.json", SCORECARD, files).filter(F.col("dir").rlike("/clinical/[^/]+$")).withColumn(
        "ensemble", F.coalesce(F.col("seed") == "ensemble", F.lit(False))).withColumn("eval_split", F.element_at(F.split("eval", "__"), -1))
    gate = read_csv_files(spark, root, "gate.csv", "label string, status string", files)
    labels = _beside(read_csv_files(spark, root, "per_label.csv", per_label_schema, files), gate, ["dir", "label"], "left")
    return cards, _beside(labels, cards.select("dir", "run_id", "eval", "reported"))
