"""Volume statistics and automatic quality control over slice tables.

A slice table has one row per slice: ``volume_id, z, h, w, pixels``. Everything per slice is row-local; a volume
is an aggregate of small per-slice numbers, so no task ever holds a whole volume.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixels as P
from ..functions.numeric import ratio
from .pixel_quantiles import value_quantiles

INT16 = (-32768, 32767)
MAX_TILT_DEG = 1.0
# fixed values: the reason and flag texts of the quality report
TEXTS = {
    "empty": "empty volume",
    "nonfinite": "contains NaN or infinite values",
    "no_finite": "no finite values",
    "int16": "HU values %.0f..%.0f do not fit in int16 (-32768..32767) -- corrupt or mis-scaled data",
    "slices": "slice count %d outside [%d, %d]",
    "uncalibrated": "HU minimum too high (%.0f) -- looks uncalibrated (raw values, not true HU)",
    "constant": "near-constant volume (std=%.3f)",
    "spacing": "missing/invalid spacing",
    "z_spacing": "unusual z-spacing: %.2f mm",
    "gaps": "non-uniform slice spacing (missing or duplicated slices?) -- resampling would distort it",
    "tilt": "slice axis tilted %.1f deg from the slice normal (gantry tilt?)",
    "no_cache": "not preprocessed",
    "no_rescale": "looks uncalibrated but no RescaleSlope/RescaleIntercept was provided",
}


@dataclass(frozen=True)
class Thresholds:
    min_slices: int = 80
    max_slices: int = 650
    hu_min_uncalibrated: float = -500.0
    min_std: float = 1.0
    z_spacing_low: float = 0.3
    z_spacing_high: float = 3.0


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))


def volume_stats(slices: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Per volume: slices, pixels, non-finite pixels and min / max / mean / population std of the finite ones."""
    px = F.col(pixels)
    good = slices.select("volume_id", F.size(px).alias("k"), F.filter(px, _finite).alias("ok"))
    per_slice = good.select("volume_id", "k", F.size("ok").alias("n"), F.array_min("ok").alias("lo"), F.array_max("ok").alias("hi"),
                            P.total(F.col("ok")).alias("s"), F.aggregate("ok", F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    mean = ratio(F.sum("s"), F.sum("n"))
    var = ratio(F.sum("q"), F.sum("n")) - mean * mean
    return per_slice.groupBy("volume_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_slices"), F.sum("k").cast("bigint").alias("n_pixels"),
        F.sum(F.col("k") - F.col("n")).cast("bigint").alias("n_nonfinite"), F.min("lo").alias("hu_min"), F.max("hi").alias("hu_max"),
        mean.alias("hu_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("hu_std"))


def nonfinite_problem() -> Column:
    """Why a volume's values are unusable, from ``volume_stats`` columns; NULL when they are fine."""
    return F.when(F.col("n_pixels") == 0, TEXTS["empty"]).when(F.col("n_nonfinite") > 0, TEXTS["nonfinite"])


def int16_problem() -> Column:
    """Why a volume may not be cast to int16; checked before any cast."""
    outside = (F.col("hu_min") < INT16[0]) | (F.col("hu_max") > INT16[1])
    return F.coalesce(nonfinite_problem(), F.when(outside, F.format_string(TEXTS["int16"], F.col("hu_min"), F.col("hu_max"))))


def calibration_info(slices: DataFrame, rescale: DataFrame, threshold: float = -500.0) -> DataFrame:
    """Per volume: low percentile, whether it already looks calibrated, whether the rescale is to be applied and why not."""
    low = value_quantiles(slices, {"p_low_before": 0.005, "_high": 0.995})
    joined = low.join(rescale.select("volume_id", F.col("slope").cast("double").alias("slope"), F.col("intercept").cast("double").alias("intercept")),
                      "volume_id", "left")
    done = F.col("p_low_before") <= F.lit(float(threshold))
    known = F.col("slope").isNotNull() & F.col("intercept").isNotNull()
    applied = ~done & known
    return joined.select("volume_id", applied.alias("applied"), done.alias("already_calibrated"), "p_low_before",
                         F.when(applied, _after(F.col("p_low_before"), F.col("_high"))).alias("p_low_after"), "slope", "intercept",
                         F.when(~done & ~known, TEXTS["no_rescale"]).alias("reason"))


def _after(low: Column, high: Column) -> Column:
    """A quantile commutes with an increasing rescale; a decreasing one turns the high quantile into the low one."""
    return F.when(F.col("slope") >= 0, low).otherwise(high) * F.col("slope") + F.col("intercept")


def calibrate(slices: DataFrame, info: DataFrame) -> DataFrame:
    """Apply slope and intercept to the volumes that need it."""
    use = info.filter("applied").select("volume_id", F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    return slices.join(use, "volume_id", "left").withColumn(
        "pixels", F.when(F.col("_s").isNotNull(), F.transform("pixels", lambda v: v * F.col("_s") + F.col("_i"))).otherwise(F.col("pixels"))).select(*slices.columns)


def plausibility(slices: DataFrame) -> DataFrame:
    """Min, max, mean, 1st and 99th percentile and whether background air is present."""
    stats = volume_stats(slices).select("volume_id", F.col("hu_min").alias("min"), F.col("hu_max").alias("max"), F.col("hu_mean").alias("mean"))
    return stats.join(value_quantiles(slices, {"p01": 0.01, "p99": 0.99}), "volume_id").withColumn("looks_like_hu", F.col("min") < -500.0)


def floor_pixels(slices: DataFrame, floor: float | None) -> DataFrame:
    """Values below the floor become the floor."""
    if floor is None:
        return slices
    return slices.withColumn("pixels", F.transform("pixels", lambda v: F.greatest(v, F.lit(float(floor)))))


def floor_audit(slices: DataFrame, floor: float | None) -> DataFrame:
    """Range per volume before the floor, and whether the floor changed anything."""
    low = slices.select("volume_id", F.array_min("pixels").alias("lo"), F.array_max("pixels").alias("hi")).groupBy("volume_id").agg(
        F.min("lo").alias("hu_min_before"), F.max("hi").alias("hu_max_before"))
    hit = F.col("hu_min_before") < F.lit(float(floor)) if floor is not None else F.lit(False)
    return low.withColumn("hu_floor", F.lit(floor).cast("double")).withColumn("floored", hit)


def _per_source(by_source: dict[str, Thresholds] | None, default: Thresholds, field: str) -> Column:
    out = F.lit(getattr(default, field))
    for source, t in (by_source or {}).items():
        out = F.when(F.col("source_name") == source, F.lit(getattr(t, field))).otherwise(out)
    return out


def check_volumes(stats: DataFrame, default: Thresholds = Thresholds(), by_source: dict[str, Thresholds] | None = None) -> DataFrame:
    """Reasons to exclude, flags to note, and ``passed``. ``stats`` has volume_stats columns and spacing_{z,y,x}_mm."""
    def t(f):
        return _per_source(by_source, default, f)
    n, spacing = F.col("n_slices"), [F.col(f"spacing_{a}_mm") for a in "zyx"]
    good = F.lit(True)
    for s in spacing:
        good = good & F.coalesce(_finite(s) & (s > 0), F.lit(False))
    reasons = F.array(
        F.when((n < t("min_slices")) | (n > t("max_slices")), F.format_string(TEXTS["slices"], n, t("min_slices"), t("max_slices"))),
        F.when(F.col("n_nonfinite") > 0, TEXTS["nonfinite"]), F.when(F.col("hu_min").isNull(), TEXTS["no_finite"]),
        F.when(F.col("hu_min") > t("hu_min_uncalibrated"), F.format_string(TEXTS["uncalibrated"], F.col("hu_min"))),
        F.when(F.col("hu_std") < t("min_std"), F.format_string(TEXTS["constant"], F.col("hu_std"))), F.when(~good, TEXTS["spacing"]))
    odd = good & ((spacing[0] > t("z_spacing_high")) | (spacing[0] < t("z_spacing_low")))
    flags = F.array(F.when(odd, F.format_string(TEXTS["z_spacing"], spacing[0])))
    return with_passed(stats.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull())).withColumn("flags", F.filter(flags, lambda x: x.isNotNull())))


def with_passed(df: DataFrame) -> DataFrame:
    return df.withColumn("passed", F.size("reasons") == 0)


def loader_checks(checked: DataFrame) -> DataFrame:
    """Geometry facts (``z_uniform``, ``tilt_deg``; NULL = unknown): uneven gaps exclude, a tilt is noted."""
    gaps = F.array(F.when(F.col("z_uniform") == F.lit(False), TEXTS["gaps"]))
    tilt = F.array(F.when(F.col("tilt_deg") > MAX_TILT_DEG, F.format_string(TEXTS["tilt"], F.col("tilt_deg"))))
    return with_passed(checked.withColumn("reasons", F.concat("reasons", F.filter(gaps, lambda x: x.isNotNull())))
                       .withColumn("flags", F.concat("flags", F.filter(tilt, lambda x: x.isNotNull()))))


def qc_report(manifest: DataFrame, stats: DataFrame, default: Thresholds = Thresholds(), by_source: dict[str, Thresholds] | None = None) -> DataFrame:
    """One row per manifest volume with joined texts; a volume without statistics was not preprocessed."""
    checked = loader_checks(check_volumes(manifest.join(stats, "volume_id", "left"), default, by_source))
    absent = F.col("n_pixels").isNull()
    return checked.select("volume_id", F.when(absent, False).otherwise(F.col("passed")).alias("passed"),
                          F.when(absent, TEXTS["no_cache"]).otherwise(F.array_join("reasons", "; ")).alias("reasons"),
                          F.when(absent, "").otherwise(F.array_join("flags", "; ")).alias("flags"), "n_slices", "hu_min", "hu_max", "hu_std")
