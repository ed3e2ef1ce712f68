"""Numbers: safe division, logits, HU windows, display text."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EPS = 1e-6


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, NULL when b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def logit(p: Column) -> Column:
    q = clip(p, EPS, 1 - EPS)
    return F.log(q) - F.log1p(-q)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_gamma_half(twice: Column) -> Column:
    """ln Gamma(twice / 2) for a whole number of halves, from the product down to Gamma(1) or Gamma(1/2)."""
    odd = twice % 2 == 1
    steps = F.sequence(F.lit(1), F.floor((twice + 1) / 2).cast("int"))
    factor = lambda k: F.when(odd, k - F.lit(0.5)).otherwise(k.cast("double"))
    top = twice / F.lit(2.0)
    return F.when(odd, F.lit(0.5723649429247001)).otherwise(0.0) + F.aggregate(
        steps, F.lit(0.0), lambda total, k: total + F.when(factor(k) < top, F.log(factor(k))).otherwise(0.0))


def chi_square_tail(chi2: Column, dof: Column) -> Column:
    """Probability of a chi-square above ``chi2``: the regularised upper incomplete gamma function of dof / 2 and chi2 / 2.

    Below the mean the power series of the lower function, above it the continued fraction of the upper one, from its end; their
    lengths grow with the root of dof, which leaves both exact to some 13 digits. NULL without degrees of freedom; dof is a whole number.
    """
    a, x = dof / F.lit(2.0), chi2 / F.lit(2.0)
    steps = F.sequence(F.lit(1), (F.lit(150) + F.lit(15) * F.sqrt(a)).cast("int"))
    front = F.exp(a * F.log(x) - x - log_gamma_half(dof))  # x^a e^-x / Gamma(a)
    series = F.aggregate(steps, F.struct((F.lit(1.0) / a).alias("term"), (F.lit(1.0) / a).alias("total")), lambda s, n: F.struct(
        (s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")), lambda s: s["total"])
    last = x + F.lit(2.0) * F.size(steps) + F.lit(1.0) - a
    fraction = F.aggregate(F.reverse(steps), last, lambda t, n: x + F.lit(2.0) * n - F.lit(1.0) - a - n * (n - a) / t)
    return F.when(dof > 0, F.when(x <= 0, 1.0).when(x < a + 1, F.lit(1.0) - front * series).otherwise(front / fraction))


def prior_log_odds(prevalence: Column) -> Column:
    q = clip(prevalence, 1e-4, 1 - 1e-4)
    return F.log(q / (F.lit(1.0) - q))


def clip_zscore(hu: Column, low: float, high: float, mean: float, std: float) -> Column:
    return (clip(hu, low, high) - F.lit(float(mean))) / F.lit(float(std))


def hu_window(hu: Column, low: float, high: float, mean: float = 0.0, std: float = 1.0) -> Column:
    """One HU window scaled to [0, 1], then normalised."""
    unit = (clip(hu, low, high) - F.lit(float(low))) / F.lit(float(high - low))
    return (unit - F.lit(float(mean))) / F.lit(float(std))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def mean_std_text(mean: Column, std: Column, digits: int = 4) -> Column:
    """``0.8083 ± 0.0005``; the mean alone when there is no spread."""
    def text(x):
        return F.format_string(f"%.{digits}f", x)
    return F.when(mean.isNull(), F.lit(None).cast("string")).when(std.isNull(), text(mean)).otherwise(
        F.concat(text(mean), F.lit(" ± "), text(std)))


def bce(p: Column, y: Column, pos_weight: Column | None = None) -> Column:
    """Binary cross entropy of a probability, positives optionally weighted."""
    positive = y * F.log(clip(p, 1e-12, 1.0))
    if pos_weight is not None:
        positive = pos_weight * positive
    return -(positive + (F.lit(1.0) - y) * F.log(clip(F.lit(1.0) - p, 1e-12, 1.0)))


def asymmetric_loss(p: Column, y: Column, gamma_neg=4.0, gamma_pos=1.0, shift=0.05, eps=1e-8) -> Column:
    """Focal loss with its own exponent per class and a probability margin for negatives."""
    miss = F.least(F.lit(1.0) - p + F.lit(float(shift)), F.lit(1.0)) if shift else F.lit(1.0) - p
    log_part = y * F.log(F.greatest(p, F.lit(eps))) + (F.lit(1.0) - y) * F.log(F.greatest(miss, F.lit(eps)))
    confidence = p * y + miss * (F.lit(1.0) - y)
    weight = F.pow(F.lit(1.0) - confidence, F.lit(float(gamma_pos)) * y + F.lit(float(gamma_neg)) * (F.lit(1.0) - y))
    return -(log_part * weight)


def symmetric_kl(p: Column, q: Column) -> Column:
    """KL both ways between two Bernoulli probabilities."""
    a, b = clip(p, 1e-12, 1 - 1e-12), clip(q, 1e-12, 1 - 1e-12)
    return (a - b) * (F.log(a) - F.log(b)) + (b - a) * (F.log(F.lit(1.0) - a) - F.log(F.lit(1.0) - b))


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
