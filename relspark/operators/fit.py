"""Fits: a few aggregates over the data, a small object for the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions.numeric import CLIP, logit, rms_distance, sigmoid
from relspark.operators import ranks
from relspark.operators.storage import written


def scale_of(mad: Column, std: Column) -> Column:
    """1.4826 MAD, else the sample deviation, else 1."""
    mad = mad * 1.4826
    return F.when(mad > 1e-8, mad).when(std > 1e-8, std).otherwise(F.lit(1.0))


def robust_profile(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, median, scale by group, of a long table with a value in each row: medians first, then deviations from them."""
    spread = df.groupBy(*by).agg(F.stddev_samp(value).alias("_sd"))
    dealt = ranks.cells(df, value, by)
    medians = written(ranks.cell_quantiles(dealt, by, {"median": 0.5}), "medians")
    mad = ranks.cell_quantiles(ranks.distances(dealt, by, medians, "median"), by, {"_mad": 0.5}).select(*by, "_mad")
    return medians.join(mad, by).join(spread, by).select(*by, "n", "median", scale_of(F.col("_mad"), F.col("_sd")).alias("scale"))


def long_form(df: DataFrame, array: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias("feature", "value"))


def profile_arrays(df: DataFrame, array: str) -> tuple[list[float], list[float]]:
    """Medians and scales of an array column's places, for the driver: as many as the array is long."""
    rows = sorted(robust_profile(long_form(df, array), "value", ["feature"]).collect(), key=lambda r: r.feature)
    return [r.median for r in rows], [r.scale for r in rows]


def order_statistic(df: DataFrame, value: str, rank: Column, by: list[str]) -> DataFrame:
    """The rank-th smallest value (from 1) by group; rank may use n, the group's rows."""
    return ranks.order_statistics(df, value, by, {"_found": rank}).select(*by, F.col("_found").alias(value), "n")


def higher_quantile(q: float) -> Column:
    """Rank of the q quantile that is no interpolation: element ceil(q (n - 1)) counted from 0."""
    return F.ceil(F.lit(q) * (F.col("n") - 1)) + 1


def conformal_rank(alpha: float) -> Column:
    return F.least(F.col("n"), F.ceil((F.col("n") + 1) * F.lit(1 - alpha)))


def ood_threshold(df: DataFrame, array: str, center: Column, scales: Column, q: float = 0.99) -> float:
    """Distance that a share q of the reference rows doesn't exceed."""
    d = df.select(rms_distance(F.col(array), center, scales).alias("d"))
    return order_statistic(d, "d", higher_quantile(q), []).first().d


def conformal_quantile(df: DataFrame, y: str, p: str, alpha: float = 0.1) -> float:
    """Order statistic of 1 - (probability of the true label)."""
    score = df.select((1 - F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))).alias("s"))
    return order_statistic(score, "s", conformal_rank(alpha), []).first().s


def temperature(df: DataFrame, y: str, x: str, low: float = 0.05, high: float = 20.0, grid: int = 33, rounds: int = 6) -> float:
    """Temperature of least loss of sigmoid(x / t): each round takes the losses of a whole grid in one scan and narrows it.

    The loss is unimodal in the logarithm of t; six rounds of 33 leave a bracket of 1e-6 of the first.
    """
    a, b = math.log(low), math.log(high)
    for _ in range(rounds):
        ts = [a + (b - a) * i / (grid - 1) for i in range(grid)]
        z = [F.col(x) / math.exp(t) for t in ts]
        losses = df.agg(*[F.avg(F.greatest(v, F.lit(0.0)) - F.col(y) * v + F.log1p(F.exp(-F.abs(v)))) for v in z]).first()
        best = min(range(grid), key=lambda i: losses[i])
        a, b = ts[max(0, best - 1)], ts[min(grid - 1, best + 1)]
    return math.exp((a + b) / 2)


def platt(df: DataFrame, y: str, x: str, l2: float = 1e-4, steps: int = 100) -> tuple[float, float]:
    """Slope and intercept by Newton steps, five sums over the data each; the slope alone is penalised."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.col(x) * a + b)))
        w = F.greatest(p * (1 - p), F.lit(1e-9))
        e = p - F.col(y)
        ga, gb, haa, hab, hbb = df.agg(F.sum(e * F.col(x)), F.sum(e), F.sum(w * F.col(x) * F.col(x)), F.sum(w * F.col(x)), F.sum(w)).first()
        ga, haa = ga + l2 * a, haa + l2
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if math.hypot(da, db) < 1e-9:
            break
    return a, b


def logits(df: DataFrame, p: str, name: str = "x") -> DataFrame:
    return df.withColumn(name, logit(F.col(p), CLIP))


def temperature_steps(df: DataFrame, y: str, logits: str, floor: float = 1e-3, most: int = 60, tolerance: float = 1e-10) -> tuple[float, float]:
    """(temperature, loss) of least mean loss of sigmoid(logit / t), with t = exp(x) + floor, by quasi-Newton steps from x = 0.

    One pass takes the loss and its slope at five step lengths at once; the longest that lowers the loss enough is taken, and two
    slopes give the curvature for the next step. Ends when the slope is below the tolerance or no step helps. Null rows are
    left out; without rows the temperature is 1 + floor and the loss NaN.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(logits).isNotNull())

    def at(xs: list[float]) -> list[tuple[float, float]]:
        out = []
        for x in xs:
            t = math.exp(x) + floor
            z = F.col(logits) / t
            out += [F.avg(F.greatest(z, F.lit(0.0)) - z * F.col(y) + F.log1p(F.exp(-F.abs(z)))), F.avg((sigmoid(z) - F.col(y)) * z * (-math.exp(x) / t))]
        row = rows.agg(*out).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(xs))]

    x, ((loss, slope),) = 0.0, at([0.0])
    if loss is None:
        return math.exp(x) + floor, math.nan
    curvature = max(abs(slope), 1e-3)
    for _ in range(most):
        if abs(slope) < tolerance:
            break
        step = max(-2.0, min(2.0, -slope / curvature))
        trials = [x + step * 0.4**k for k in range(5)]
        found = at(trials)
        k = next((k for k, (f, _) in enumerate(found) if f <= loss + 1e-4 * slope * (trials[k] - x)), None)
        if k is None:
            break
        change = (found[k][1] - slope) / (trials[k] - x)
        curvature = change if change > 1e-12 else curvature / 2
        x, (loss, slope) = trials[k], found[k]
    return math.exp(x) + floor, loss
