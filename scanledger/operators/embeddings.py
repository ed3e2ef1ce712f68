"""Embedding analytics over slice rows ``(volume_id, slice_idx, emb)``.

Vector means and variances are ``pyspark.ml.stat.Summarizer`` aggregates: partial sums of whole vectors combine on
the map side and nothing is exploded per dimension.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import finite, ratio, sigmoid
from ..functions.vectors import cosine, dot, norm, standardize, unit

STD_FLOOR = 1e-6


def vector_mean(df: DataFrame, keys: Sequence[str], emb: str = "emb", out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(F.col(emb))).alias("_m")).select(*keys, vector_to_array("_m").alias(out))


def mean_embeddings(slices: DataFrame) -> DataFrame:
    """One mean vector per volume."""
    return vector_mean(slices, ["volume_id"], out="emb")


def feature_norm(slices: DataFrame) -> DataFrame:
    """One row: mean and population std per dimension over all given slices, std at least 1e-6."""
    stats = slices.agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("emb")).alias("s"))
    arrays = stats.select(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n"))
    scale = (F.col("n") - 1).cast("double") / F.col("n")
    return arrays.select("mean", F.transform("var", lambda v: F.greatest(F.sqrt(v * scale), F.lit(STD_FLOOR))).alias("std"))


def apply_norm(slices: DataFrame, stats: DataFrame) -> DataFrame:
    """Standardise with a one-row ``feature_norm`` table (a scalar subquery, evaluated once)."""
    both = slices.withColumn("_mean", stats.select("mean").scalar()).withColumn("_std", stats.select("std").scalar())
    return both.withColumn("emb", standardize(F.col("emb"), F.col("_mean"), F.col("_std"))).select(*slices.columns)


def norm_diagnostics(slices: DataFrame) -> DataFrame:
    """Per volume: slices, whether all values are finite, mean and population std of the norms, largest value."""
    row = slices.select("volume_id", F.forall("emb", finite).alias("ok"), norm(F.col("emb")).alias("norm"),
                        F.array_max(F.transform("emb", lambda v: F.abs(v))).alias("top"))
    return row.groupBy("volume_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_slices"), F.bool_and("ok").alias("finite"), F.avg("norm").alias("norm_mean"),
                                        F.stddev_pop("norm").alias("norm_std"), F.max("top").alias("abs_max"))


def extreme_rows(stats: DataFrame, column: str, n: int = 2) -> DataFrame:
    """The first and last n rows by a column: two bounded top-n selections."""
    low = stats.orderBy(F.col(column).asc(), "volume_id").limit(n)
    high = stats.orderBy(F.col(column).desc(), F.col("volume_id").desc()).limit(n)
    return low.unionByName(high).distinct()


def neighbour_cosine(slices: DataFrame) -> DataFrame:
    """Cosine of every slice with the next one of its volume."""
    return slice_cosine_band(slices, 1).select("volume_id", F.col("i").alias("slice_idx"), "cosine")


def slice_cosine_band(slices: DataFrame, band: int) -> DataFrame:
    """Entries (i, j) of the slice-by-slice cosine matrix with 1 <= j - i <= band, by an equi-join on i + offset."""
    units = slices.select("volume_id", "slice_idx", unit(F.col("emb")).alias("u"))
    reach = units.select("volume_id", F.col("slice_idx").alias("i"), F.col("u").alias("_a"), F.explode(F.sequence(F.lit(1), F.lit(band))).alias("_o")).withColumn(
        "j", (F.col("i") + F.col("_o")).cast("int"))
    other = units.select("volume_id", F.col("slice_idx").cast("int").alias("j"), F.col("u").alias("_b"))
    return reach.join(other, ["volume_id", "j"]).select("volume_id", "i", "j", dot(F.col("_a"), F.col("_b")).alias("cosine"))


def mean_similarity(slices: DataFrame) -> DataFrame:
    """Row means of the slice-by-slice cosine matrix: the mean of unit vectors dotted with each of them."""
    units = slices.select("volume_id", "slice_idx", unit(F.col("emb")).alias("u"))
    centre = vector_mean(units, ["volume_id"], "u", "_c")
    return units.join(centre, "volume_id").select("volume_id", "slice_idx", dot(F.col("u"), F.col("_c")).alias("mean_cosine"))


def group_softmax(df: DataFrame, keys: Sequence[str], score: str = "score", out: str = "attention") -> DataFrame:
    """Softmax within a group; the groups are never sorted or gathered. Peak and sum come from the keys and scores alone, and the
    other columns are joined once."""
    slim = df.select(*keys, F.col(score).alias("_score"))
    peak = slim.groupBy(*keys).agg(F.max("_score").alias("_peak"))
    total = slim.join(peak, list(keys)).groupBy(*keys, "_peak").agg(F.sum(F.exp(F.col("_score") - F.col("_peak"))).alias("_sum"))
    return df.join(total, list(keys)).select(*df.columns, (F.exp(F.col(score) - F.col("_peak")) / F.col("_sum")).alias(out))


def attention_scores(slices: DataFrame, weights: DataFrame) -> DataFrame:
    """Gated attention score per slice and branch: w . (tanh(V h + bv) * sigmoid(U h + bu)) + bw.

    ``weights`` is one row: V, U (array of rows), bv, bu (arrays), w (array of branch rows), bw, branches (names).
    """
    names = ("V", "U", "bv", "bu", "w", "bw", "branches")
    arg = {n: F.col(f"_w_{n}") for n in names}

    def layer(rows: Column, bias: Column) -> Column:
        return F.zip_with(F.transform(rows, lambda r: dot(r, F.col("emb"))), bias, lambda x, b: x + b)
    gate = F.zip_with(F.transform(layer(arg["V"], arg["bv"]), F.tanh), F.transform(layer(arg["U"], arg["bu"]), sigmoid), lambda a, b: a * b)
    gated = slices.select("*", *[weights.select(n).scalar().alias(f"_w_{n}") for n in names]).withColumn("_g", gate)
    scores = F.zip_with(F.transform(arg["w"], lambda r: dot(r, F.col("_g"))), arg["bw"], lambda x, b: x + b)
    return gated.withColumn("_s", F.arrays_zip(arg["branches"].alias("branch"), scores.alias("score"))).select(
        *slices.columns, F.inline("_s")).toDF(*slices.columns, "branch", "score")


def attention_pool(scored: DataFrame) -> DataFrame:
    """Attention-weighted mean embedding per (volume, branch). Needs ``attention``."""
    weighted = scored.groupBy("volume_id", "branch").agg(Summarizer.mean(array_to_vector("emb"), F.col("attention")).alias("_m"))
    return weighted.select("volume_id", "branch", vector_to_array("_m").alias("pooled"))


def softmax_pool(scored: DataFrame) -> DataFrame:
    """Attention-weighted mean embedding per (volume, branch), straight from ``score``: a weighted mean divides by the sum of its weights, so
    only the peak has to be known."""
    peak = scored.groupBy("volume_id", "branch").agg(F.max("score").alias("_peak"))
    lifted = scored.join(peak, ["volume_id", "branch"]).withColumn("attention", F.exp(F.col("score") - F.col("_peak")))
    return attention_pool(lifted)


def linear_head(pooled: DataFrame, head: DataFrame) -> DataFrame:
    """Logit and probability per (volume, label). ``head``: label, branch, w, b."""
    return pooled.join(head, "branch").withColumn("logit", dot(F.col("pooled"), F.col("w")) + F.col("b")).select(
        "volume_id", "label", "logit", sigmoid(F.col("logit")).alias("p"))


def slice_contributions(attended: DataFrame, head: DataFrame) -> DataFrame:
    """Each slice's share of each label's logit: attention * (w . h)."""
    return attended.join(head.select("label", "branch", "w"), "branch").select(
        "volume_id", "label", "slice_idx", (F.col("attention") * dot(F.col("emb"), F.col("w"))).alias("contribution"))


def contribution_errors(contributions: DataFrame, logits: DataFrame, head: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """(volume, label) whose contributions and bias do not add up to the logit; empty when exact."""
    total = contributions.groupBy("volume_id", "label").agg(F.sum("contribution").alias("total"))
    gap = F.abs(F.col("total") + F.col("b") - F.col("logit"))
    return total.join(head.select("label", "b"), "label").join(logits, ["volume_id", "label"]).select("volume_id", "label", gap.alias("error"), "logit").filter(
        F.col("error") > F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("logit"))).drop("logit")


def top_slices(contributions: DataFrame, k: int = 5) -> DataFrame:
    """The k slices with the largest contribution per (volume, label), ties by slice number."""
    order = W.partitionBy("volume_id", "label").orderBy(F.col("contribution").desc(), "slice_idx")
    return contributions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def evidence(contributions: DataFrame, logits: DataFrame, thresholds: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Per predicted (volume, label): probability, threshold, true label and its top slices."""
    called = logits.join(thresholds.select("label", "threshold"), "label").filter(F.col("p") >= F.col("threshold"))
    top = top_slices(contributions.join(called.select("volume_id", "label"), ["volume_id", "label"], "left_semi"), k).groupBy("volume_id", "label").agg(
        F.array_sort(F.collect_list(F.struct("rank", "slice_idx", "contribution"))).alias("top_slices"))
    return called.join(top, ["volume_id", "label"]).join(truth.select("volume_id", "label", F.col("y").alias("true_label")), ["volume_id", "label"], "left").select(
        "volume_id", "label", "p", "threshold", "true_label", "top_slices")


def store_problems(record: DataFrame, *, encoder_fingerprint: str, cache_fingerprint: str | None, embed_dim: int | None, weights: str | None) -> DataFrame:
    """Adds ``problems``: how a store differs from what is asked for. Only two known values can disagree."""
    def differs(column: str, now, always: bool = False) -> Column:
        if now is None:
            return F.lit(False)
        gap = F.col(column) != F.lit(now)
        return F.coalesce(gap, F.lit(always))
    checks = [(differs("encoder_fingerprint", encoder_fingerprint, True), "encoder fingerprint"), (differs("cache_fingerprint", cache_fingerprint), "HU cache fingerprint"),
              (differs("embed_dim", embed_dim), "embed_dim"), (differs("weights", weights), "weights commit")]
    return record.withColumn("problems", F.filter(F.array(*[F.when(bad, text) for bad, text in checks]), lambda x: x.isNotNull()))


def cache_decision(sidecars: DataFrame, fingerprint: str, recorded: str | None = None, allow_new: bool = False) -> DataFrame:
    """One row: new, adopt, same, replace or refuse, from the fingerprints a cache already holds."""
    found = sidecars.agg(F.count_distinct("fingerprint").cast("bigint").alias("n"), F.min("fingerprint").alias("one"))
    if recorded is not None:
        decision = F.lit("same" if recorded == fingerprint else "replace" if allow_new else "refuse")
    else:
        other = F.lit("replace" if allow_new else "refuse")
        decision = F.when(F.col("n") == 0, "new").when((F.col("n") == 1) & (F.col("one") == fingerprint), "adopt").otherwise(other)
    return found.select(F.col("n").alias("fingerprints"), decision.alias("decision"))


def pair_cosine(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean cosine of aligned slices per pair. ``pairs``: pair, volume_a, volume_b, offset; indices are clamped to B."""
    lengths = slices.groupBy(F.col("volume_id").alias("volume_b")).agg((F.max("slice_idx") + 1).alias("_nb"))
    a = slices.select(F.col("volume_id").alias("volume_a"), F.col("slice_idx").alias("_i"), F.col("emb").alias("_ea"))
    b = slices.select(F.col("volume_id").alias("volume_b"), F.col("slice_idx").cast("int").alias("_j"), F.col("emb").alias("_eb"))
    placed = pairs.join(lengths, "volume_b").join(a, "volume_a").withColumn("_j", F.least(F.greatest(F.col("_i") + F.col("offset"), F.lit(0)), F.col("_nb") - 1).cast("int"))
    return placed.join(b, ["volume_b", "_j"]).groupBy("pair").agg(F.avg(cosine(F.col("_ea"), F.col("_eb"))).alias("mean_cosine"), F.count(F.lit(1)).cast("bigint").alias("n_slices"))


def pair_decisions(predictions: DataFrame, pairs: DataFrame, cut: float = 0.5) -> DataFrame:
    """Per pair: mean absolute change of probability and share of labels whose decision at ``cut`` differs."""
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("volume_a").alias("volume_id"), F.lit("a").alias("side")),
                                                   F.struct(F.col("volume_b").alias("volume_id"), F.lit("b").alias("side")))).alias("v")).select("pair", "v.*")
    both = predictions.select("volume_id", "label", "p").join(sides, "volume_id").groupBy("pair", "label").agg(
        F.max(F.when(F.col("side") == "a", F.col("p"))).alias("pa"), F.max(F.when(F.col("side") == "b", F.col("p"))).alias("pb"))
    flip = ((F.col("pa") >= cut) != (F.col("pb") >= cut)).cast("double")
    return both.groupBy("pair").agg(F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("mean_abs_dp"), F.avg(flip).alias("flip_rate"))


def similarity_of_selection(units: DataFrame) -> DataFrame:
    """Mean pairwise cosine per volume from the sum of its unit vectors: no pair is formed."""
    sums = units.groupBy("volume_id").agg(Summarizer.sum(array_to_vector("u")).alias("_s"), F.sum(dot(F.col("u"), F.col("u"))).alias("_q"), F.count(F.lit(1)).alias("_k"))
    s = vector_to_array("_s")
    pairs = F.col("_k") * (F.col("_k") - 1)
    return sums.select("volume_id", ratio(dot(s, s) - F.col("_q"), pairs).alias("redundancy"))


