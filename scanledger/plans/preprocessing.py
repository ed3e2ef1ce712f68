"""The preprocessing chain over slice tables, for building a cache and for ad-hoc inference batches."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..checks import CheckFailed
from ..operators import grid as G, quality as Q


@dataclass(frozen=True)
class Settings:
    target_spacing: tuple[float, float, float] = (1.5, 0.75, 0.75)
    min_change: float = 0.05
    floor: float | None = -1024.0
    crop_threshold: float = -500.0
    crop_margin: int = 4
    target_size: tuple[int, int] = (224, 224)
    resize_mode: str = "stretch"
    uncalibrated_threshold: float = -500.0
    thresholds: Q.Thresholds = Q.Thresholds()


def preprocess(slices: DataFrame, volumes: DataFrame, settings: Settings = Settings(),
               stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Slices ready to store and one report row per volume (statistics, QC, or the error that stopped it).

    ``volumes``: volume_id, spacing_{z,y,x}_mm, slope, intercept, z_uniform, tilt_deg (NULL = unknown).
    ``stage`` is applied to the slices after each step that is read more than once; pass a function that writes
    them to a table or checkpoint when volumes are large, so that nothing is computed twice.
    """
    slices = stage(slices)
    raw = Q.volume_stats(slices).withColumn("error", Q.nonfinite_problem())
    usable = slices.join(raw.filter("error IS NULL").select("volume_id"), "volume_id", "left_semi")
    calibration = Q.calibration_info(usable, volumes, settings.uncalibrated_threshold)
    level = stage(Q.calibrate(usable, calibration))
    audit = Q.floor_audit(level, settings.floor)
    plan = G.resample_plan(usable, volumes.select("volume_id", *[f"spacing_{a}_mm" for a in "zyx"]), settings.target_spacing, settings.min_change)
    even = stage(G.resample(Q.floor_pixels(level, settings.floor), plan))
    box = G.foreground_box(even, settings.crop_threshold, settings.crop_margin)
    sized = stage(G.round_half_even(G.resize(G.crop(even, box), settings.target_size, settings.resize_mode)))
    stats = Q.volume_stats(sized).withColumn("late_error", Q.int16_problem())
    good = stats.filter("late_error IS NULL")
    final = G.to_int16(sized.join(good.select("volume_id"), "volume_id", "left_semi"))
    facts = plan.select("volume_id", *[f"spacing_{a}_mm" for a in "zyx"]).join(volumes.select("volume_id", "z_uniform", "tilt_deg"), "volume_id", "left")
    checked = Q.loader_checks(Q.check_volumes(good.drop("late_error").join(facts, "volume_id"), settings.thresholds))
    report = (raw.select("volume_id", "error").join(stats.select("volume_id", "late_error"), "volume_id", "left")
              .select("volume_id", F.coalesce("error", "late_error").alias("error"))
              .join(checked.drop("n_pixels", "n_nonfinite", "z_uniform", "tilt_deg"), "volume_id", "left")
              .join(G.crop_shape(box), "volume_id", "left").join(calibration.select("volume_id", "applied", "p_low_before"), "volume_id", "left")
              .join(audit.select("volume_id", "hu_min_before", "floored"), "volume_id", "left"))
    return {"slices": final, "report": report}


def infer(slices: DataFrame, volumes: DataFrame, settings: Settings = Settings(), *, fingerprint: str | None = None,
          cache_fingerprint: str | None = None, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """Prepare ad-hoc scans exactly like the cache: slices of the scans that pass, and a status per scan."""
    if fingerprint is not None and cache_fingerprint is not None and fingerprint != cache_fingerprint:
        raise CheckFailed(f"settings {fingerprint} differ from the cache's {cache_fingerprint}")
    parts = preprocess(slices, volumes, settings, stage)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("passed"), "ready").otherwise("rejected")
    report = parts["report"].withColumn("status", status)
    ready = parts["slices"].join(report.filter("status = 'ready'").select("volume_id"), "volume_id", "left_semi")
    return {"slices": ready, "report": report}
