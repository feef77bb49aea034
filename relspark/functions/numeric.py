"""Numeric column expressions. All are null for null input and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before logarithms.
CLIP = 1e-7


def clip_probability(p: Column, by: float = CLIP) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(by)), F.lit(1 - by)))


def logit(p: Column, by: float = CLIP) -> Column:
    p = clip_probability(p, by)
    return F.log(p) - F.log1p(-p)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) by the branch whose exponential can't overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def temperature(x: Column, t: float) -> Column:
    return sigmoid(x / F.lit(t))


def platt(x: Column, slope: float, intercept: float) -> Column:
    return sigmoid(x * F.lit(slope) + F.lit(intercept))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def all_finite(xs: Column) -> Column:
    return F.forall(xs, is_finite)


def robust_z(xs: Column, medians: Column, scales: Column) -> Column:
    """Largest |x - median| / scale of an array."""
    z = F.zip_with(F.zip_with(xs, medians, lambda x, m: F.abs(x - m)), scales, lambda d, s: d / s)
    return F.array_max(z)


def soft_quality(z: Column, soft: float = 6.0) -> Column:
    return F.exp(-0.5 * F.pow(z / F.lit(soft), F.lit(2.0)))


def rms_distance(xs: Column, center: Column, scales: Column) -> Column:
    """Root of the mean squared standardised distance of an array from a center."""
    d = F.zip_with(F.zip_with(xs, center, lambda x, c: x - c), scales, lambda d, s: (d / s) * (d / s))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))


def ratio(xs: Column, baseline: Column) -> Column:
    """Elementwise x / baseline; null where the baseline is 0 or missing."""
    return F.zip_with(xs, baseline, lambda x, b: F.try_divide(x, b))


def percent_change(base: Column, new: Column) -> Column:
    """Signed per cent with two places, N/A on a zero or missing base."""
    change = F.try_divide(new - base, base) * 100
    return F.when(change.isNull(), "N/A").otherwise(F.format_string("%+.2f%%", change))


def finite_or_null(x: Column) -> Column:
    """Text or number as double; null unless finite."""
    d = x.try_cast("double")
    return F.when(is_finite(d), d)


def resample_index(i: Column, source: int, target: int) -> Column:
    """Index at another rate, rounded half to even."""
    return F.bround(i * F.lit(target) / F.lit(source)).cast("long")


def difficulty(d: Column) -> Column:
    return F.when(d < 0.8, "hard").when(d < 1.5, "medium").otherwise("easy")
