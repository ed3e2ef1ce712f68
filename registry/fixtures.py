"""The fixture views over the given tables, as DataFrames (same rows as ``fixtures_sql.py``)."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from scanledger.functions.hashing import hash01
from scanledger.functions.ids import strip_nifti_ext
from scanledger.operators.kernels import catalog, parsed_metadata
from scanledger.operators.splits import ROWS_PER_TASK
from scanledger.staging import shared_folder


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark, sf, name: str, derive) -> DataFrame:
    """A derived table, written once per application and read from there."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN or not exists(spark, _WRITTEN[key]):
        path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        derive(spark, sf).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def parsed_volumes(spark, sf) -> DataFrame:
    """Study metadata with parsed ids, one row per file entry of a pool, written as a table: names and what their ids are fit for
    are stored values to the operators, not expressions that the optimizer repeats in every predicate and every scan."""
    stored = once(spark, sf, "metadata", lambda *at: parsed_metadata(derive_volumes(*at)).drop("volume_id"))
    return stored.withColumn("volume_id", strip_nifti_ext(F.col("VolumeName")))


def volumes(spark, sf) -> DataFrame:
    """Study metadata, one row per file entry of a pool."""
    return parsed_volumes(spark, sf).drop("volume_id", "status")


def exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def derive_volumes(spark, sf) -> DataFrame:
    # what depends on the order or the part alone is made there, not for each of their lines
    o, p = F.col("o_orderkey"), table(spark, sf, "part")
    valid = F.col("o_custkey") % 8 == 0
    orders = table(spark, sf, "orders").select(
        o, F.when(valid != (o % 89 == 0), "valid").otherwise("train").alias("pool"),
        F.concat(F.when(valid, "valid_").otherwise("train_"), F.col("o_custkey").cast("string"), F.lit("_"),
                 F.translate(o.cast("string"), "0123456789", "abcdefghij"), F.lit("_")).alias("_head"),
        F.when(o % 97 == 0, "x.nii.gz").otherwise(".nii.gz").alias("_tail"))
    parts = p.select("p_partkey", F.col("p_type").alias("Manufacturer"),
                     F.concat(F.lit("['"), F.regexp_replace("p_brand", "#", ""), F.lit("', '3']")).alias("ConvolutionKernel"), F.col("p_name").alias("SeriesDescription"))
    # one input file is one task: spread its rows before names are built, by the key they are joined on
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount").repartition("l_orderkey")
    return (line.join(orders, F.col("l_orderkey") == o).join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select("pool", F.concat("_head", F.col("l_linenumber").cast("string"), "_tail").alias("VolumeName"), "Manufacturer", "ConvolutionKernel",
                    "SeriesDescription", F.col("l_quantity").cast("bigint").alias("NumberofSlices"),
                    F.lit(512).alias("Rows"), F.lit(512).alias("Columns"), F.lit("[0.9, 0.9]").alias("XYSpacing"),
                    (F.lit(0.5) + F.lit(10.0) * F.col("l_discount")).alias("ZSpacing")))


def kernel_table(spark, sf) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return (table(spark, sf, "part").filter(number % 3 < 2)
            .select(F.col("p_type").alias("manufacturer"), F.regexp_replace("p_brand", "#", "").alias("kernel"),
                    F.when(number % 3 == 0, "sharp").otherwise("soft").alias("class")).distinct())


def the_catalog(spark, sf) -> DataFrame:
    return catalog(parsed_volumes(spark, sf), kernel_table(spark, sf))


def volume_keys(spark, sf) -> DataFrame:
    """Ids of the catalog without its kernel columns, written as a table: manifest and report of a query read the same ids."""
    def derive(spark, sf):
        ids = parsed_volumes(spark, sf).filter("status = 'ok'").select("volume_id")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // ROWS_PER_TASK))
        return ids.repartition(tasks, "volume_id").distinct()

    return once(spark, sf, "keys", derive)


def qc_rows(spark, sf) -> DataFrame:
    u = hash01(F.concat(F.lit("qc:"), F.col("volume_id")))
    return volume_keys(spark, sf).filter(u < 0.98).select("volume_id", (u >= 0.05).alias("passed"))


def existing_splits(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").filter("c_custkey % 5 = 0 AND c_custkey % 8 <> 0").select(
        F.concat(F.lit("train_"), F.col("c_custkey").cast("string")).alias("patient_id"),
        F.when(F.col("c_custkey") % 2 == 0, "val").otherwise("test").alias("split"))


def _documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


def findings(spark, sf) -> DataFrame:
    patient = F.floor(F.col("doc_id") / 4)
    return _documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("volume_id"), F.col("source").alias("manufacturer"), F.col("lang").alias("kernel_class"),
        F.col("n_chars").alias("n_slices"), patient.cast("string").alias("patient_id"), F.floor(F.col("doc_id") / 2).cast("string").alias("scan_id"),
        F.when(patient % 5 == 0, "val").when(patient % 5 == 1, "test").otherwise("train").alias("split"),
        F.col("quality").cast("double").alias("label_quality"), F.col("toxic").cast("double").alias("label_toxic"))


def predictions(spark, sf) -> DataFrame:
    patient = F.floor(F.col("doc_id") / 4)

    def prob(label, tag):
        u = hash01(F.concat(F.lit(tag), F.col("doc_id").cast("string")))
        return F.round(F.lit(0.35) * F.coalesce(F.col(label).cast("double"), F.lit(0.5)) + F.lit(0.65) * u, 3)

    return _documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("volume_id"), patient.cast("string").alias("patient_id"),
        F.floor(F.col("doc_id") / 2).cast("string").alias("scan_id"), F.when(patient % 3 == 0, "val").otherwise("test").alias("split"),
        F.when(F.col("doc_id") % 2 == 0, "sharp").otherwise("soft").alias("kernel_class"), F.col("source").alias("manufacturer"),
        prob("quality", "q:").alias("prob_quality"), prob("toxic", "t:").alias("prob_toxic"),
        F.col("quality").cast("double").alias("true_quality"), F.col("toxic").cast("double").alias("true_toxic"))


def ensemble(spark, sf) -> DataFrame:
    """Three members' predictions, stacked."""
    def prob(label, tag):
        u = hash01(F.concat(F.lit(tag), F.col("member").cast("string"), F.lit(":"), F.col("volume_id")))
        return F.round(F.lit(0.35) * F.coalesce(F.col(f"true_{label}"), F.lit(0.5)) + F.lit(0.65) * u, 3)

    base = predictions(spark, sf).drop("prob_quality", "prob_toxic").withColumn("member", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return base.withColumn("prob_quality", prob("quality", "q")).withColumn("prob_toxic", prob("toxic", "t"))


def slices(spark, sf) -> DataFrame:
    """Slice embeddings."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 10).cast("string").alias("volume_id"), (F.col("vec_id") % 10).cast("int").alias("slice_idx"),
        F.col("embedding").cast("array<double>").alias("emb"))


def pixel_slices(spark, sf) -> DataFrame:
    """Slice table: one row per slice with its pixels, 8 x 8."""
    return slices(spark, sf).select("volume_id", F.col("slice_idx").alias("z"), F.lit(8).alias("h"), F.lit(8).alias("w"),
                                    F.transform("emb", lambda v: F.round(v * 2000.0)).alias("pixels"))


def headers(spark, sf) -> DataFrame:
    """Slice header rows of two series per folder."""
    v, z = F.col("volume_id").cast("int"), F.col("slice_idx")
    pz = (F.when((v % 11 == 0) & (z == 5), F.lit(1.5) * 4).when((v % 7 == 0) & (z > 6), F.lit(1.5) * (z + 2)).otherwise(F.lit(1.5) * z))
    return slices(spark, sf).select(
        F.concat(F.lit("folder_"), F.floor(v / 2).cast("string")).alias("folder"), F.col("volume_id").alias("series_uid"),
        F.concat(F.lit("img"), (9 - z).cast("string"), F.lit(".dcm")).alias("file"), F.lit(8).alias("n_rows"),
        F.when((v % 13 == 0) & (z == 4), 9).otherwise(8).alias("n_cols"),
        F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("iop"),
        F.array(F.lit(0.0), F.when(v % 17 == 0, F.lit(0.2) * z).otherwise(F.lit(0.0)), pz).alias("ipp"),
        F.array(F.lit(0.7), F.lit(0.8)).alias("pixel_spacing"), F.lit(1.5).alias("slice_thickness"),
        F.concat(F.lit("maker_"), (v % 3).cast("string")).alias("manufacturer"), F.concat(F.lit("K"), (v % 5).cast("string")).alias("kernel"),
        F.when(v % 19 == 0, "").otherwise(F.concat(F.lit("P"), F.col("volume_id"))).alias("patient_tag"),
        (F.lit(1.0) + F.when((v % 5 == 0) & (z == 3), 1.0).otherwise(0.0)).alias("slope"), F.lit(-1024.0).alias("intercept"))


def files(spark, sf) -> DataFrame:
    """File inventory: path, length in bytes and, for slices, the series they belong to."""
    k = F.col("page_id") % 5
    suffix = (F.when(k == 0, ".nii.gz").when(k == 1, "/s1.dcm").when(k == 2, "/s2").when(k == 3, ".tar.gz").otherwise("/.hidden/s3.dcm"))
    return table(spark, sf, "pages").select(
        F.concat(F.regexp_replace(F.substring_index("url", "?", 1), "^[a-z]+://", ""), suffix).alias("path"),
        F.length("html").cast("bigint").alias("length"), F.concat(F.lit("1.2."), (F.col("page_id") % 7).cast("string")).alias("series_uid"))


def chunk_log(spark, sf) -> DataFrame:
    """Ingest outcomes, one row per volume of a chunk."""
    return table(spark, sf, "events").select(
        "event_id", F.floor(F.col("event_id") / 20).cast("string").alias("chunk"),
        F.concat(F.lit("vol_"), (F.col("event_id") % 5000).cast("string")).alias("volume_id"),
        (F.col("event_type") == "error").alias("failed"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("RuntimeError: "), F.col("props"))).alias("error"),
        (F.col("event_type") == "click").alias("cached"), "ts", "value")


def curves(spark, sf) -> DataFrame:
    """Training curves: epochs of runs; three losses and times per epoch."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), (F.col("user_id") % 10).alias("config"),
        F.col("user_id").alias("seed"), F.row_number().over(w).cast("bigint").alias("epoch"), F.col("value").alias("val_loss"),
        (F.col("value") + e % 7).alias("train_loss"), (F.lit(1.0) / (1 + e % 50)).alias("lr"), (F.lit(0.1) * (e % 30)).alias("seconds"))
