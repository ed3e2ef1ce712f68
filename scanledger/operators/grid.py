"""Geometry of slice tables: foreground box, crop, resample, resize, filters, profiles.

In-plane work is row-local. Along z every slice is sent to the output slices it contributes to (two per output at
most) and combined there: one shuffle, no join of a volume with itself.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pixels as P
from ..functions.hashing import hash01
from ..functions.numeric import ratio


def _replace(df: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """Replace columns by expressions over the old ones. New values get their own names first: inside a lambda a
    name would otherwise resolve to the new column of the same select."""
    named = df.select("*", *[c.alias(f"_new_{k}") for k, c in new.items()])
    return named.select(*[F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in columns])


def extents(slices: DataFrame) -> DataFrame:
    return slices.groupBy("volume_id").agg((F.max("z") + 1).cast("int").alias("n_z"), F.max("h").alias("n_y"), F.max("w").alias("n_x"))


def foreground_box(slices: DataFrame, threshold: float = -500.0, margin: int = 4) -> DataFrame:
    """Half-open box of all pixels above the threshold, widened by a margin; the whole volume when there is none."""
    hit = slices.select("volume_id", "z", "h", "w", P.above(F.col("pixels"), threshold).alias("at"))
    per_slice = hit.select("volume_id", "z", "h", "w", F.when(F.size("at") > 0, F.col("z")).alias("zz"),
                           F.floor(F.array_min("at") / F.col("w")).alias("y0"), F.floor(F.array_max("at") / F.col("w")).alias("y1"),
                           F.array_min(F.transform("at", lambda i: i % F.col("w"))).alias("x0"), F.array_max(F.transform("at", lambda i: i % F.col("w"))).alias("x1"))
    box = per_slice.groupBy("volume_id").agg(
        (F.max("z") + 1).alias("n_z"), F.max("h").alias("n_y"), F.max("w").alias("n_x"), F.min("zz").alias("z0"), F.max("zz").alias("z1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))

    def low(a: str) -> Column:
        return F.when(F.col("z0").isNull(), F.lit(0)).otherwise(F.greatest(F.col(f"{a}0") - margin, F.lit(0))).cast("int").alias(f"{a}0")

    def high(a: str) -> Column:
        return F.when(F.col("z0").isNull(), F.col(f"n_{a}")).otherwise(F.least(F.col(f"{a}1") + 1 + margin, F.col(f"n_{a}"))).cast("int").alias(f"{a}1")
    return box.select("volume_id", *[f(a) for a in "zyx" for f in (low, high)])


def crop(slices: DataFrame, box: DataFrame) -> DataFrame:
    """Slices and pixels inside the box, renumbered from zero."""
    joined = slices.join(box, "volume_id").filter((F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1")))
    px = P.crop(F.col("pixels"), F.col("h"), F.col("w"), F.col("y0"), F.col("y1"), F.col("x0"), F.col("x1"))
    new = {"z": (F.col("z") - F.col("z0")).cast("int"), "h": F.col("y1") - F.col("y0"), "w": F.col("x1") - F.col("x0"), "pixels": px}
    return _replace(joined, slices.columns, new)


def crop_shape(box: DataFrame) -> DataFrame:
    return box.select("volume_id", F.concat_ws("x", *[(F.col(f"{a}1") - F.col(f"{a}0")).cast("string") for a in "zyx"]).alias("crop_shape"))


def resize_in_plane(slices: DataFrame, new_h: Column, new_w: Column) -> DataFrame:
    sized = slices.withColumn("_h", new_h.cast("int")).withColumn("_w", new_w.cast("int"))
    px = P.resize(F.col("pixels"), F.col("h"), F.col("w"), F.col("_h"), F.col("_w"))
    same = (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))
    return _replace(sized, slices.columns, {"pixels": F.when(same, F.col("pixels")).otherwise(px), "h": F.col("_h"), "w": F.col("_w")})


def resample_z(slices: DataFrame, n_out: DataFrame) -> DataFrame:
    """Linear resample along z to ``n_out`` slices per volume (columns volume_id, n_in, n_out).

    Slice z reaches output j when j's corner-aligned source position lies within one slice of z.
    """
    step = (F.col("n_in") - 1).cast("double") / F.greatest(F.col("n_out") - 1, F.lit(1))
    first = F.when(step == 0, F.lit(0)).otherwise(F.greatest(F.ceil((F.col("z") - 1) / step) - 1, F.lit(0)))
    last = F.when(step == 0, F.col("n_out") - 1).otherwise(F.least(F.floor((F.col("z") + 1) / step) + 1, F.col("n_out") - 1))
    sent = slices.join(n_out, "volume_id").filter(first <= last).withColumn("j", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    at = F.col("j") * (F.col("n_in") - 1).cast("double") / F.greatest(F.col("n_out") - 1, F.lit(1))
    lo = F.floor(at).cast("int")
    sent = sent.withColumn("_lo", lo).withColumn("_f", at - lo)
    below, beyond = F.col("z") == F.col("_lo"), (F.col("z") == F.col("_lo") + 1) & (F.col("_f") > 0)
    sent = sent.filter(below | beyond)
    both = sent.groupBy("volume_id", "j").agg(F.max("h").alias("h"), F.max("w").alias("w"), F.max("_f").alias("_f"),
                                              F.any_value(F.when(below, F.col("pixels")), F.lit(True)).alias("a"),
                                              F.any_value(F.when(beyond, F.col("pixels")), F.lit(True)).alias("b"))
    px = F.when(F.col("b").isNull(), F.col("a")).otherwise(F.zip_with("a", "b", lambda a, b: P.lerp(a, b, F.col("_f"))))
    return both.select("volume_id", F.col("j").alias("z"), "h", "w", px.alias("pixels"))


def resample_plan(slices: DataFrame, spacing: DataFrame, target=(1.5, 0.75, 0.75), min_change: float = 0.05) -> DataFrame:
    """Old and new extent and new spacing per volume. A volume is left alone only when all axes are close enough."""
    joined = extents(slices).join(spacing, "volume_id")
    factors = {a: F.col(f"spacing_{a}_mm") / F.lit(float(t)) for a, t in zip("zyx", target)}
    close = F.lit(True)
    for f in factors.values():
        close = close & (F.abs(f - 1.0) < min_change)
    plan = joined.withColumn("_close", close)
    for a, f in factors.items():
        plan = plan.withColumn(f"new_{a}", F.when(F.col("_close"), F.col(f"n_{a}")).otherwise(
            F.greatest(F.bround(F.col(f"n_{a}") * f, 0), F.lit(1.0))).cast("int"))
    return plan.select("volume_id", *[f"n_{a}" for a in "zyx"], *[f"new_{a}" for a in "zyx"], *[
        (F.col(f"spacing_{a}_mm") / (F.col(f"new_{a}") / F.col(f"n_{a}"))).alias(f"spacing_{a}_mm") for a in "zyx"])


def resample(slices: DataFrame, plan: DataFrame) -> DataFrame:
    """Trilinear resample to the planned extents: in-plane first, then along z."""
    cols = slices.columns
    flat = slices.join(plan.select("volume_id", "new_y", "new_x"), "volume_id")
    flat = resize_in_plane(flat, F.col("new_y"), F.col("new_x")).select(*cols)
    return resample_z(flat, plan.select("volume_id", F.col("n_z").alias("n_in"), F.col("new_z").alias("n_out")))


def resize(slices: DataFrame, target: tuple[int, int], mode: str = "stretch") -> DataFrame:
    """Every slice to one pixel grid: independent axes, or aspect-preserving and centred on the volume's minimum."""
    th, tw = target
    if mode == "stretch":
        return resize_in_plane(slices, F.lit(th), F.lit(tw))
    if mode != "pad":
        raise ValueError(f"resize mode must be 'stretch' or 'pad', got {mode!r}")
    low = slices.select("volume_id", F.array_min("pixels").alias("lo")).groupBy("volume_id").agg(F.min("lo").alias("_fill"))
    scale = F.least(F.lit(float(th)) / F.col("h"), F.lit(float(tw)) / F.col("w"))
    nh, nw = (F.greatest(F.bround(F.col(c) * scale, 0), F.lit(1.0)).cast("int") for c in ("h", "w"))
    fit = resize_in_plane(slices.join(low, "volume_id"), nh, nw)
    px = P.pad(F.col("pixels"), F.col("h"), F.col("w"), th, tw, F.col("_fill"))
    new = {"pixels": px, "h": F.lit(th), "w": F.lit(tw)}
    return _replace(fit, slices.columns, new)


def round_half_even(slices: DataFrame) -> DataFrame:
    return slices.withColumn("pixels", F.transform("pixels", lambda v: F.bround(v, 0)))


def to_int16(slices: DataFrame) -> DataFrame:
    """Cast rounded values; run ``quality.int16_problem`` first."""
    return slices.withColumn("pixels", F.col("pixels").cast("array<smallint>"))


def rescale_slices(slices: DataFrame) -> DataFrame:
    """Each slice by its own ``slope`` and ``intercept``."""
    return slices.withColumn("pixels", F.transform("pixels", lambda v: v * F.col("slope") + F.col("intercept")))


def rescale_varies(slices: DataFrame) -> DataFrame:
    return slices.groupBy("volume_id").agg((F.count_distinct("slope", "intercept") > 1).alias("rescale_varies"))


def sharpness(slices: DataFrame, low: float = -900.0, high: float = 300.0) -> DataFrame:
    """Mean absolute Laplacian of the central 60 % of slices over pixels inside (low, high); 0 when there are none."""
    n = slices.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_n"))
    edge = F.floor(F.col("_n") / 5)
    mid = slices.join(n, "volume_id").filter((F.col("z") >= edge) & (F.col("z") < F.col("_n") - edge))
    hits = F.filter(P.inner_laplacian(F.col("pixels"), F.col("h"), F.col("w")), lambda c: (c["center"] > low) & (c["center"] < high))
    per_slice = mid.select("volume_id", hits.alias("hits")).select(
        "volume_id", F.size("hits").alias("n"), F.aggregate("hits", F.lit(0.0), lambda a, c: a + F.abs(c["lap"])).alias("s"))
    return per_slice.groupBy("volume_id").agg(F.coalesce(ratio(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("score"))


def slice_profile(slices: DataFrame) -> DataFrame:
    return slices.select("volume_id", "z", (P.total(F.col("pixels")) / F.size("pixels")).alias("mean_hu"))


def kernel_augment(slices: DataFrame, kind: str, low: float, high: float, seed: int = 0, sharpen_sigma: float = 1.0) -> DataFrame:
    """Simulate the other kernel: blur by a sigma, or sharpen by an amount, drawn per volume from [low, high]."""
    strength = F.lit(float(low)) + hash01(F.concat_ws(":", F.lit(f"{seed}"), F.col("volume_id"))) * F.lit(float(high - low))
    drawn = slices.withColumn("_s", strength)
    sigma = F.col("_s") if kind == "blur" else F.lit(float(sharpen_sigma))
    out = P.bind(P.gaussian_taps(sigma), lambda taps: P.blur(F.col("pixels"), F.col("h"), F.col("w"), taps))
    if kind == "sharpen":
        out = P.sharpen(F.col("pixels"), out, F.col("_s"))
    elif kind != "blur":
        raise ValueError(f"kind must be 'blur' or 'sharpen', got {kind!r}")
    return _replace(drawn, slices.columns, {"pixels": out})


def align_offset(profile_a: DataFrame, profile_b: DataFrame, max_offset: int = 2) -> DataFrame:
    """Per pair: the offset with the least mean absolute difference between two slice profiles, and whether it can be trusted.

    Profiles are (pair, i, v). Slice i of A meets slice i + offset of B. Each slice of A meets at most 2 m + 1 slices.
    """
    lengths = profile_a.groupBy("pair").agg(F.count(F.lit(1)).alias("na")).join(profile_b.groupBy("pair").agg(F.count(F.lit(1)).alias("nb")), "pair")
    shifted = profile_a.select("pair", F.col("v").alias("va"), "i", F.explode(F.sequence(F.lit(-max_offset), F.lit(max_offset))).alias("o")).withColumn(
        "i", F.col("i") + F.col("o"))
    met = shifted.join(profile_b.select("pair", "i", F.col("v").alias("vb")), ["pair", "i"])
    errors = met.groupBy("pair", "o").agg(F.count(F.lit(1)).alias("overlap"), F.avg(F.abs(F.col("va") - F.col("vb"))).alias("err"))
    usable = errors.join(lengths, "pair").filter(
        (F.abs(F.col("na") - F.col("nb")) <= max_offset) & (F.col("overlap") >= F.greatest(F.lit(8), F.floor(F.least("na", "nb") / 2))))
    best = usable.groupBy("pair").agg(F.min(F.struct("err", "o")).alias("b")).select("pair", F.col("b.o").alias("offset"), F.col("b.err").alias("err"))
    return lengths.select("pair").join(best, "pair", "left").select(
        "pair", F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"), F.col("err").isNotNull().alias("aligned"))
