"""Group statistics, tests and effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import safe


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, sample deviation (0 below two rows), min, max of the positive values by group."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def welch(df: DataFrame, value: str, group: str, a, b, by: list[str]) -> DataFrame:
    """t and degrees of freedom of the means of two groups, null where they aren't defined."""
    side = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    m = df.groupBy(*by).agg(*[side(f, g).alias(f"{n}{k}") for k, g in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s1, s2 = (F.col(f"v{k}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}")) for k in (1, 2))
    t = safe(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2), None)
    df_ = safe((s1 + s2) * (s1 + s2), s1 * s1 / F.greatest(F.col("n1") - 1, F.lit(1)) + s2 * s2 / F.greatest(F.col("n2") - 1, F.lit(1)), None)
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    return m.select(*by, F.when(ok, t).alias("t"), F.when(ok, df_).alias("df"))


def student_p(t: float, df: float) -> float:
    """Two-sided p value: the regularised incomplete beta function by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x in (0.0, 1.0):
        return float(x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 500):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + k / c
                c = c if abs(c) > tiny else tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def p_bucket(p: float) -> str:
    return next((f"p < {c}" for c in (0.001, 0.01, 0.05, 0.10) if p < c), "not significant")


def cohens_d(df: DataFrame, value: str, one: Column, by: list[str]) -> DataFrame:
    """Absolute difference of means over the root of the mean population variance, by group (at least 1e-10)."""
    side = lambda f, c: f(F.when(c, F.col(value)))
    pooled = F.sqrt((side(F.var_pop, one) + side(F.var_pop, ~one)) / 2)
    pooled = F.when(pooled == 0, F.lit(1e-10)).otherwise(pooled)
    return df.groupBy(*by).agg((F.abs(side(F.avg, one) - side(F.avg, ~one)) / pooled).alias("d"))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariances of the columns, (i, j, cov) with i <= j, by one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])).alias("x")).select("x.*")


def pearson(x: Column, y: Column) -> Column:
    """Correlation; 0 where a variance is 0."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(F.when(vx * vy > 0, vx * vy))).otherwise(F.lit(0.0))
