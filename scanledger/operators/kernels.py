"""Reconstruction kernels: classification against the reviewed table, drafting and surveying it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import draft_kernel_class, is_volume_id, kernel_key, normalize_kernel, strip_nifti_ext, volume_id_parts
from ..functions.numeric import count_if, ratio
from .ordering import first_per

KERNEL_CLASSES = ("sharp", "soft", "other")


def bad_kernel_rows(kernel_table: DataFrame) -> DataFrame:
    """Rows of a kernel table whose class is not one of the three; empty for a usable table."""
    return kernel_table.filter(~F.coalesce(F.col("class").isin(*KERNEL_CLASSES), F.lit(False)))


def classify(df: DataFrame, kernel_table: DataFrame, *, manufacturer: str = "manufacturer", kernel: str = "kernel",
             normalized: bool = False) -> DataFrame:
    """Adds ``kernel`` (normalised) and ``kernel_class``; pairs not in the table are ``other``.

    The table holds one row per known pair. The join carries no hint: Spark broadcasts it when its measured
    size is below the session's threshold and splits a hot pair with the skew join otherwise.
    """
    m, k = kernel_key(F.col("manufacturer"), F.col("kernel"))
    lookup = kernel_table.select(m.alias("_m"), k.alias("_k"), "class").groupBy("_m", "_k").agg(F.max("class").alias("_class"))
    name = F.col(kernel) if normalized else normalize_kernel(F.col(kernel))
    out = df.withColumn("_dm", F.lower(F.trim(F.coalesce(F.col(manufacturer), F.lit(""))))).withColumn("_dk", F.lower(name))
    out = out.join(lookup, (F.col("_dm") == F.col("_m")) & (F.col("_dk") == F.col("_k")), "left")
    keep = [c for c in df.columns if c not in ("kernel", "kernel_class")]
    return out.select(*keep, name.alias("kernel"), F.coalesce("_class", F.lit("other")).alias("kernel_class"))


def parsed_metadata(meta: DataFrame) -> DataFrame:
    """Metadata rows with their clean id and whether they are usable: ``ok``, ``unparsable``, ``wrong_pool``; parsed rows stay as they are."""
    if {"volume_id", "status"} <= set(meta.columns):
        return meta
    vid = strip_nifti_ext(F.col("VolumeName"))
    own = F.substring_index(vid, "_", 1)
    status = F.when(~is_volume_id(vid), "unparsable").when(own != F.col("pool"), "wrong_pool").otherwise("ok")
    return meta.withColumn("volume_id", vid).withColumn("status", status)


def catalog(meta: DataFrame, kernel_table: DataFrame) -> DataFrame:
    """One row per volume of its own pool with parsed ids, manufacturer, kernel and kernel class."""
    usable = parsed_metadata(meta).filter("status = 'ok'").select(
        "volume_id", "pool", F.col("Manufacturer").alias("manufacturer"), normalize_kernel(F.col("ConvolutionKernel")).alias("kernel"))
    one = first_per(usable, ["volume_id", "pool"], ["manufacturer", "kernel"])
    parts = volume_id_parts(F.col("volume_id"))
    ids = one.select("volume_id", *[c.alias(n) for n, c in parts.items()], "manufacturer", "kernel")
    return classify(ids, kernel_table, normalized=True)


def catalog_counts(meta: DataFrame) -> DataFrame:
    """Per pool: metadata rows, unparsable ids, ids of the other pool."""
    return parsed_metadata(meta).groupBy("pool").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), count_if(F.col("status") == "unparsable").alias("unparsable"),
        count_if(F.col("status") == "wrong_pool").alias("wrong_pool"))


def draft_table(meta: DataFrame) -> DataFrame:
    """Draft class per (manufacturer, kernel): the majority guess, its share, the usual description."""
    rows = meta.filter(F.col("Manufacturer").isNotNull()).select(
        F.col("Manufacturer").alias("manufacturer"), normalize_kernel(F.col("ConvolutionKernel")).alias("kernel"),
        F.coalesce("SeriesDescription", F.lit("(empty)")).alias("description"),
        draft_kernel_class(F.col("Manufacturer"), F.col("ConvolutionKernel"), F.col("SeriesDescription")).alias("draft"))
    counted = rows.groupBy("manufacturer", "kernel", "draft", "description").agg(F.count(F.lit(1)).alias("n"))
    keys = ["manufacturer", "kernel"]

    def most_common(column: str, out: str) -> DataFrame:
        sums = counted.groupBy(*keys, column).agg(F.sum("n").alias("n"))
        best = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v")))
        return sums.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("total")).select(
            *keys, F.col("best.v").alias(out), (-F.col("best.n")).alias(f"{out}_n"), F.col("total").alias(f"{out}_total"))

    votes, names = most_common("draft", "class"), most_common("description", "common_description")
    return votes.join(names, keys).select(
        *keys, "class", F.col("class_total").cast("bigint").alias("n_volumes"),
        F.round(ratio(F.col("class_n"), F.col("class_total")), 3).alias("agreement"), "common_description", F.lit("draft").alias("status"))


def survey_pairs(worklist: DataFrame, scores: DataFrame) -> DataFrame:
    """Scans with exactly two volumes, both scored: the two kernels, scores and the sharper one."""
    rows = worklist.select("volume_id", "patient_id", "scan_id", "reconstruction_id", "manufacturer", "kernel").join(
        scores.select("volume_id", F.col("score")), "volume_id", "left")
    view = F.struct("reconstruction_id", "volume_id", "manufacturer", "kernel", "score")
    two = rows.groupBy("patient_id", "scan_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.min(view).alias("a"), F.max(view).alias("b")).filter("n = 2 AND n_scored = 2")
    return two.select("patient_id", "scan_id", F.col("a.manufacturer").alias("manufacturer"), F.col("a.kernel").alias("kernel_a"),
                      F.col("b.kernel").alias("kernel_b"), F.col("a.score").alias("score_a"), F.col("b.score").alias("score_b"),
                      F.when(F.col("a.score") > F.col("b.score"), F.col("a.kernel")).otherwise(F.col("b.kernel")).alias("sharper_kernel"))


def survey_verdict(pairs: DataFrame, kernel_table: DataFrame, agree: float = 0.8) -> DataFrame:
    """How often each kernel was the sharper one of its pair, against the table."""
    views = F.array(*[F.struct(F.col(k).alias("kernel"), (F.col("sharper_kernel") == F.col(k)).cast("bigint").alias("win"))
                      for k in ("kernel_a", "kernel_b")])
    sides = pairs.filter(F.col("kernel_a") != F.col("kernel_b")).select("manufacturer", F.inline(views))
    summary = sides.groupBy("manufacturer", "kernel").agg(
        F.count(F.lit(1)).cast("bigint").alias("pairs"), F.sum("win").cast("bigint").alias("sharper")).withColumn(
        "share_sharper", F.round(ratio(F.col("sharper"), F.col("pairs")), 2))
    return with_verdict(classify(summary, kernel_table).withColumnRenamed("kernel_class", "table_class"), agree)


def with_verdict(summary: DataFrame, agree: float) -> DataFrame:
    share: Column = F.col("share_sharper")
    measured = F.when(share >= agree, "sharp").when(share <= round(1 - agree, 10), "soft").otherwise("unclear")
    return summary.withColumn("verdict", F.when(
        (F.col("table_class") == "other") | (measured == "unclear"), F.concat(F.lit("check ("), measured, F.lit(")"))).when(
        measured == F.col("table_class"), "ok").otherwise(F.concat(F.lit("DISAGREES (measured "), measured, F.lit(")"))))
