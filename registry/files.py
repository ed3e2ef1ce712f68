"""Registered queries: readers and writers on files that Spark derives from the given tables (section 2.1)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from scanledger.checks import CheckFailed
from scanledger.functions import ids as I
from scanledger.operators import manifest as M
from scanledger.sources import experiments as SE, raw as SX, readers as SR, writers as SW
from scanledger.staging import shared_folder

from . import Registry, fixtures as X
from .common import tidy

reg = Registry()


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@reg.add("src1_metadata_scan", """SELECT pool, regexp_replace("VolumeName",'\\.nii(\\.gz)?$','') AS "VolumeName", "Manufacturer", "ConvolutionKernel", "NumberofSlices"::VARCHAR AS "NumberofSlices", "XYSpacing" FROM volumes""")
def _(spark, sf):
    root, v = folder(spark, "metadata"), X.volumes(spark, sf)
    names = [c.split()[0] for c in SR.METADATA_SCHEMA.split(", ")]
    for pool in ("train", "valid"):
        rows = v.filter(F.col("pool") == pool).select(*[F.col(c).cast("string").alias(c) if c in v.columns else F.lit(None).cast("string").alias(c) for c in names])
        rows.write.option("header", True).csv(f"{root}/{pool}")
    out = SR.read_metadata(spark, {p: f"{root}/{p}" for p in ("train", "valid")})
    return out.select("pool", "VolumeName", "Manufacturer", "ConvolutionKernel", "NumberofSlices", "XYSpacing")


def write_labels(spark, sf, root):
    f = X.findings(spark, sf)
    rows = f.select(F.concat(F.lit("v"), F.col("volume_id"), F.lit(".nii.gz")).alias("VolumeName"), F.col("label_quality").alias("Quality"),
                    F.when(F.col("label_toxic").isNull(), "unclear").otherwise(F.col("label_toxic").cast("string")).alias("Is toxic"))
    rows.filter(F.col("VolumeName") < "v5").write.option("header", True).csv(f"{root}/a")
    rows.filter(F.col("VolumeName") >= "v5").write.option("header", True).csv(f"{root}/b")


@reg.add("src2_label_scan", """SELECT 'v'||volume_id AS volume_id, label_quality AS "Quality", label_toxic AS "Is toxic" FROM findings""")
def _(spark, sf):
    root = folder(spark, "labels")
    write_labels(spark, sf, root)
    return SR.read_labels(spark, [f"{root}/a", f"{root}/b", f"{root}/absent"])


@reg.add("src3_keyed_labels", """SELECT 'v'||volume_id||'.nii.gz' AS "VolumeName", label_quality AS "Quality", label_toxic AS "Is toxic" FROM findings""")
def _(spark, sf):
    root = folder(spark, "labels")
    write_labels(spark, sf, root)
    return SR.read_keyed_labels(spark, f"{root}/*")


@reg.add("src4_chunk_manifests", "SELECT volume_id, (volume_id::INT%4)::VARCHAR AS ingest_chunk, CASE WHEN volume_id::INT%4<2 THEN n_slices END AS n_slices, CASE WHEN volume_id::INT%4>=2 THEN manufacturer END AS manufacturer FROM findings")
def _(spark, sf):
    root = folder(spark, "chunks")
    f = X.findings(spark, sf).withColumn("ingest_chunk", F.col("volume_id").cast("int") % 4)
    f.filter("ingest_chunk < 2").select("volume_id", "n_slices", "ingest_chunk").write.partitionBy("ingest_chunk").parquet(root)
    f.filter("ingest_chunk >= 2").select("volume_id", "manufacturer", "ingest_chunk").write.mode("append").partitionBy("ingest_chunk").parquet(root)
    return SR.read_chunk_manifests(spark, root).select("volume_id", "ingest_chunk", "n_slices", "manufacturer")


@reg.add("src5_sidecar_scan", "SELECT volume_id, 'fp'||(volume_id::INT%3) AS fingerprint, n_slices, volume_id::INT%2=0 AS z_uniform FROM findings WHERE volume_id::INT%10>0")
def _(spark, sf):
    root = folder(spark, "sidecars")
    v = F.col("volume_id").cast("int")
    f = X.findings(spark, sf)
    doc = F.to_json(F.struct("volume_id", F.concat(F.lit("fp"), (v % 3).cast("string")).alias("fingerprint"), F.struct((v % 2 == 0).alias("z_uniform")).alias("loader_checks"),
                             F.struct("n_slices").alias("stats")))
    f.select(F.when(v % 10 == 0, F.lit('{"volume_id": "broken')).otherwise(doc).alias("value")).write.text(root)
    return SR.read_sidecars(spark, root, one_per_file=False).select("volume_id", "fingerprint", "stats.n_slices", "loader_checks.z_uniform")


# every page as a file: four kinds of name, and a name without a suffix whose content tells
PAGE_FILE = ("split_part(split_part(url,'://',2),'/',1)||'/'||page_id||CASE page_id%5 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.dcm' WHEN 2 THEN '' WHEN 3 THEN '.tar.gz' ELSE '.NII' END")


@reg.add("src8_file_type_sniff", f"""SELECT {PAGE_FILE} AS path, octet_length(encode(coalesce(html,'')))+CASE WHEN page_id%5=2 AND page_id%2=0 THEN 132 ELSE 0 END AS length,
  CASE WHEN page_id%5 IN (0,4) THEN 'nifti' WHEN page_id%5=1 OR (page_id%5=2 AND page_id%2=0) THEN 'dicom' ELSE 'other' END AS kind FROM pages""")
def _(spark, sf):
    root, page = folder(spark, "sniff"), F.col("page_id")
    head = F.when((page % 5 == 2) & (page % 2 == 0), F.concat(F.repeat(F.lit(" "), 128), F.lit("DICM"))).otherwise("")
    SX.write_files(X.table(spark, sf, "pages").select(F.expr(PAGE_FILE).alias("path"), F.encode(F.concat(head, F.coalesce("html", F.lit(""))), "utf-8").alias("content")), root)
    return SR.sniff_types(SR.read_inventory(spark, root, uri=True)).select("path", "length", "kind")


def write_runs(spark, sf, root):
    """One folder per run with its config, record, curves, validation metrics and one evaluation."""
    rows = X.curves(spark, sf).select("run_id", "config", "seed", "epoch", "val_loss", "lr")

    def files(pdf):
        import json

        import pandas as pd
        run, cfg, seed = pdf["run_id"].iloc[0], int(pdf["config"].iloc[0]), int(pdf["seed"].iloc[0])
        texts = {"config.yaml": f"name: exp\nseed: {seed}\noptim:\n  lr: 0.001\n  max_epochs: {50 + cfg}\ndata:\n  source: s\n  run: r\n",
                 "run_info.json": json.dumps({"run_id": run, "config_hash": f"{cfg:08d}ffff", "status": "finished" if seed % 5 else "running", "best_epoch": 3}),
                 "val_metrics.json": json.dumps({"macro_auroc": float(pdf["val_loss"].min()), "n_volumes": 10}),
                 "metrics.csv": pdf.sort_values("epoch")[["epoch", "val_loss", "lr"]].to_csv(index=False),
                 "eval/s__r__test/metrics_summary.csv": f"group_by,group,macro_auroc\nall,all,{pdf['val_loss'].max()}\n",
                 "clinical/s__r__test/scorecard.json": json.dumps({"run_id": run, "name": "exp", "seed": str(seed), "members": 1, "eval": "s__r__test", "reported": "2024", "headline": {"n": float(seed)}}),
                 "clinical/s__r__test/per_label.csv": "group_by,group,label,auroc\nall,all,quality,0.5\nall,all,toxic,0.25\n",
                 "clinical/s__r__test/gate.csv": "label,status\nquality,supported\n"}
        return pd.DataFrame([(f"exp/{cfg:08d}/seed{seed}/{name}", text.encode()) for name, text in texts.items()], columns=["path", "content"])

    SX.write_files(rows.groupBy("run_id").applyInPandas(files, "path string, content binary"), root)


RUN_ROWS = "(SELECT run_id, min(config) AS config, min(seed) AS seed, min(val_loss) AS lo, max(val_loss) AS hi FROM curves GROUP BY 1)"


@reg.add("src9_experiment_runs", f"SELECT run_id, 'exp' AS name, lpad(config::VARCHAR,8,'0') AS hash8, seed, CASE WHEN seed%5=0 THEN 'running' ELSE 'finished' END AS status, 50+config AS max_epochs, round(lo,9) AS val_macro_auroc FROM {RUN_ROWS}")
def _(spark, sf):
    root = folder(spark, "runs")
    write_runs(spark, sf, root)
    return tidy(SE.load_runs(spark, root).select("run_id", "name", "hash8", "seed", "status", "max_epochs", "val_macro_auroc"))


@reg.add("src9_experiment_curves", "SELECT run_id, epoch, round(val_loss,9) AS val_loss, round(lr,9) AS lr FROM curves")
def _(spark, sf):
    root = folder(spark, "runs")
    write_runs(spark, sf, root)
    return tidy(SE.load_curves(spark, root, "epoch bigint, val_loss double, lr double").select("run_id", "epoch", "val_loss", "lr"))


@reg.add("src9_evaluations", f"SELECT run_id, 's__r__test' AS eval, 'test' AS eval_split, 'all' AS group_by, round(hi,9) AS macro_auroc FROM {RUN_ROWS}")
def _(spark, sf):
    root = folder(spark, "runs")
    write_runs(spark, sf, root)
    return tidy(SE.load_evaluations(spark, root, "metrics_summary.csv", "group_by string, group string, macro_auroc double").select("run_id", "eval", "eval_split", "group_by", "macro_auroc"))


@reg.add("src10_clinical_reports", f"SELECT run_id, label, auroc, status, 's__r__test' AS eval FROM {RUN_ROWS}, (SELECT 'quality' AS label, 0.5::DOUBLE AS auroc, 'supported' AS status UNION ALL SELECT 'toxic', 0.25, NULL)")
def _(spark, sf):
    root = folder(spark, "runs")
    write_runs(spark, sf, root)
    return SE.load_clinical(spark, root, "group_by string, group string, label string, auroc double")[1].select("run_id", "label", "auroc", "status", "eval")


@reg.add("snk1_write_once", "SELECT volume_id, split, true AS refused FROM findings")
def _(spark, sf):
    path, f = folder(spark, "worklist"), X.findings(spark, sf).select("volume_id", "split")
    SW.write_once(f, path)
    try:
        SW.write_once(f.limit(0), path)
        refused = False
    except CheckFailed:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


def ledger(spark, sf) -> str:
    """Two writers' batches with different columns; the first batch is sent again, in other rows, which changes nothing."""
    path, f = folder(spark, "ledger"), X.findings(spark, sf)
    even = F.col("volume_id").cast("int") % 2 == 0
    SW.append_ledger(f.filter(even).select("volume_id", "label_quality"), path, "1/2", "even")
    SW.append_ledger(f.filter(~even).select("volume_id", "label_toxic"), path, "1/2", "odd")
    SW.append_ledger(f.select("volume_id", "label_quality"), path, "1/2", "even")
    return path


@reg.add("snk2_ledger_append", "SELECT volume_id, label_quality, NULL::DOUBLE AS label_toxic FROM findings WHERE volume_id::INT%2=0 UNION ALL SELECT volume_id, NULL, label_toxic FROM findings WHERE volume_id::INT%2=1")
def _(spark, sf):
    return SW.read_ledger(spark, ledger(spark, sf)).select("volume_id", "label_quality", "label_toxic")


@reg.add("snk2_ledger_batches", "SELECT CASE WHEN volume_id::INT%2=0 THEN 'even' ELSE 'odd' END AS _writer, '1/2' AS _batch, count(*) AS n_rows FROM findings GROUP BY 1,2")
def _(spark, sf):
    return SW.read_ledger(spark, ledger(spark, sf), provenance=True).groupBy("_writer", "_batch").agg(F.count(F.lit(1)).alias("n_rows"))


@reg.add("snk3_store_roundtrip", "SELECT volume_id, count(*) AS n FROM slices WHERE volume_id::INT%7>0 GROUP BY 1")
def _(spark, sf):
    path = folder(spark, "store")
    broken = X.slices(spark, sf).withColumn("emb", F.when((F.col("volume_id").cast("int") % 7 == 0) & (F.col("slice_idx") == 2), F.slice("emb", 1, 3)).otherwise(F.col("emb")))
    SW.write_embeddings(SW.validate_embeddings(broken, 64), path)
    return SR.read_embeddings(spark, path).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))


@reg.add("snk5_report_bundle", "SELECT split, count(*) AS n FROM findings WHERE n_slices%2=0 GROUP BY 1")
def _(spark, sf):
    path, f = folder(spark, "report"), X.findings(spark, sf)
    for rows in (f, f.filter("n_slices % 2 = 0")):
        SW.write_report({"splits": rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "kernels": rows.groupBy("kernel_class").agg(F.count(F.lit(1)).alias("n"))}, path)
    return spark.read.parquet(f"{path}/splits")


@reg.add("se4_set_equality", "SELECT volume_id, 'second' AS only_in FROM findings WHERE volume_id::INT%20=0")
def _(spark, sf):
    f = X.findings(spark, sf).select("volume_id")
    return M.set_differences(f.filter(F.col("volume_id").cast("int") % 20 > 0), f)


def inventory(spark, root: str) -> DataFrame:
    return SR.read_inventory(spark, root)


@reg.add("src6_file_inventory", """SELECT 'split='||coalesce(split,'__HIVE_DEFAULT_PARTITION__') AS folder, true AS has_files, sum(octet_length(encode(volume_id))+1)::BIGINT AS bytes FROM findings GROUP BY 1""")
def _(spark, sf):
    """Text files of known length: how many there are is left to Spark, their bytes are not."""
    root = folder(spark, "files")
    X.findings(spark, sf).select("split", "volume_id").write.partitionBy("split").text(root)
    rows = inventory(spark, root).filter(I.file_suffix(F.col("path")) == "txt")
    parts = F.split("signature", ":")
    return SR.source_signature(rows).select("folder", (parts[0].cast("bigint") > 0).alias("has_files"), parts[1].cast("bigint").alias("bytes"))
