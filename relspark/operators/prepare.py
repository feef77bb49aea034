"""Preparing labelled rows: windows, baselines, trimming, balancing, folds, domain alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.functions.hashing import digest
from relspark.functions.numeric import is_finite, ratio
from relspark.operators import ranks


def label_windows(df: DataFrame, by: str, index: str, label: str, points: int, step: int) -> DataFrame:
    """Windows of `points` labels beginning at each step-th row whose first label is 1 to 4 and whose sum is that label
    times the points. The last full window is left out, as the windows' starts stop before n - points.
    """
    order = Window.partitionBy(by).orderBy(index)
    ahead = order.rowsBetween(0, points - 1)
    out = df.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(by)), "_s": F.sum(label).over(ahead)})
    out = out.where((F.col("_i") % step == 0) & (F.col("_i") < F.col("_n") - points) & F.col(label).between(1, 4) & (F.col("_s") == F.col(label) * points))
    return out.select(by, F.col(index).alias("start"), F.col(label).alias("label"))


def signal_windows(signal: Column, points: int, step: int) -> Column:
    """All full windows of an array, the last one included."""
    n = F.size(signal)
    starts = F.sequence(F.lit(0), n - points, F.lit(step))
    return F.when(n >= points, F.transform(starts, lambda i: F.slice(signal, i + 1, F.lit(points)))).otherwise(F.array().cast("array<array<double>>"))


def baseline_ratio(df: DataFrame, by: list[str], neutral: Column, columns: list[str]) -> DataFrame:
    """Columns divided by the group's neutral median; where all of a group's are missing by its median over all rows, then 1.

    A baseline is at least 1e-8. Medians are a row for each group, from ranges of values.
    """
    both = {f"_n_{c}": F.when(neutral, F.col(c)) for c in columns} | {f"_a_{c}": F.col(c) for c in columns}
    m = ranks.column_quantiles(df, by, both, {"m": 0.5})
    none = F.coalesce(*[F.col(f"_n_{c}_m") for c in columns]).isNull()
    m = m.select(*by, *[F.greatest(F.coalesce(F.when(none, F.col(f"_a_{c}_m")).otherwise(F.col(f"_n_{c}_m")), F.lit(1.0)), F.lit(1e-8)).alias(f"_b_{c}") for c in columns])
    out = df.join(m, by)
    return out.select(*df.columns, *[(F.col(c) / F.col(f"_b_{c}")).alias(f"{c}_ratio") for c in columns])


def robust_baseline(whole: DataFrame, windows: DataFrame, by: list[str], feature: str, value: str) -> DataFrame:
    """(by..., feature, value, origin): a signal's features from the whole of it, or from its windows where the whole has failed.

    Both tables are long. The whole has failed if any of its features is missing or not finite; then each feature is the median of
    the windows where it is finite (origin `windows`), null if there is none (origin `none`). Signals that only have windows count too.
    """
    finite = lambda df: df.where(is_finite(F.col(value)))
    good = whole.groupBy(*by).agg(F.min(is_finite(F.col(value)).cast("int")).alias("_ok"))
    kept = whole.join(good.where("_ok = 1").select(*by), by, "left_semi").select(*by, feature, value, F.lit("whole").alias("origin"))
    names = whole.select(*by, feature).unionByName(windows.select(*by, feature)).distinct()
    left = names.join(good.where("_ok = 1").select(*by), by, "left_anti")
    medians = ranks.quantiles(finite(windows.join(good.where("_ok = 1").select(*by), by, "left_anti")), value, [*by, feature], {"_m": 0.5})
    rest = left.join(medians, [*by, feature], "left").select(*by, feature, F.col("_m").alias(value), F.when(F.col("_m").isNull(), "none").otherwise("windows").alias("origin"))
    return kept.unionByName(rest)


def robust_scaled(df: DataFrame, by: list[str], columns: list[str], clip: float) -> DataFrame:
    """df with <column>_z: distance from the group's median over its interquartile range (1e-6 at least), held to +-clip."""
    q = ranks.column_quantiles(df, by, {c: F.col(c) for c in columns}, {"low": 0.25, "mid": 0.5, "high": 0.75})
    out = df.join(q, by) if by else df.crossJoin(F.broadcast(q))  # without groups one row
    z = {c: (F.col(c) - F.col(f"{c}_mid")) / F.greatest(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(1e-6)) for c in columns}
    return out.select(*df.columns, *[F.least(F.greatest(v, F.lit(-clip)), F.lit(clip)).alias(f"{c}_z") for c, v in z.items()])


def trim(df: DataFrame, by: list[str], columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows none of whose columns lies strictly outside its group's quantiles (linear interpolation)."""
    q = ranks.column_quantiles(df, by, {c: F.col(c) for c in columns}, {"low": low, "high": high})
    out = df.join(q, by)
    for c in columns:
        out = out.where(F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high")))
    return out.select(df.columns)


def balance(df: DataFrame, label: str, focus: object, order: Column, share: float = 0.333) -> DataFrame:
    """Every stride-th row of each class, in a fixed order, so that the focus class is about as large as three others.

    The focus class comes to the least of its size and three times any other's, the others to share times that.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))  # a row for each class
    mine = F.col(label) == F.lit(focus)
    whole = F.min(F.when(mine, F.col("_n")).otherwise(3 * F.col("_n"))).over(Window.partitionBy())
    target = F.greatest(F.when(mine, whole).otherwise(F.floor(whole * F.lit(share))), F.lit(1))
    strides = sizes.withColumn("_stride", F.ceil(F.col("_n") / target).cast("long")).select(label, "_stride")
    rows = ranks.numbered(df, [label], [order]).join(strides, label)
    return rows.where((F.col("_i") - 1) % F.col("_stride") == 0).select(df.columns)


def moving_average(value: str, by: list[str], order: str, half: int) -> Column:
    """Mean of a row and `half` rows on either side; beyond the ends stand zeros."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0)) / (2 * half + 1)


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """df with chosen: a fixed share of each class (half up), by the order of a seeded digest of the key."""
    rows = ranks.numbered(df, [label], [digest(str(seed), F.col(key)), F.col(key)])
    return rows.withColumn("chosen", F.col("_i") <= F.floor(F.col("_n") * F.lit(fraction) + 0.5)).drop("_i", "_n")


def equal_bins(df: DataFrame, value: str, tie: str, bins: int, by: list[str]) -> DataFrame:
    """df with bin, from 1: as many rows in each bin of a group as can be, the first bins one more."""
    rows = ranks.numbered(df, by, [F.col(value), F.col(tie)])
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    edge = more * (small + 1)
    place = F.col("_i") - 1
    number = F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("bin", (number + 1).cast("int")).drop("_i", "_n")


def choose_subjects(df: DataFrame, subject: str, ratio: str, fraction: float, bins: int, seed: int = 42) -> DataFrame:
    """(subject, ratio, bin, chosen): a share of the subjects (half to even, at least one, not all), spread over bins of their ratio.

    Bins are equal runs by (ratio, subject), at most as many as are chosen; each gives its part by the level that `target` rises to,
    its subjects in the order of a seeded digest. One subject alone is chosen. A subject without a ratio comes first.
    """
    rows = df.select(subject, ratio)
    n = rows.count()
    target = n if n <= 1 else min(n - 1, max(1, round(n * fraction)))
    rows = equal_bins(rows, ratio, subject, max(1, min(max(1, bins), n, target)), [])
    takes = ranks.level(rows.groupBy("bin").agg(F.count("*").alias("_size")), "bin", "_size", target).select("bin", "take")
    order = [digest(str(seed), F.col(subject)), F.col(subject)]
    rows = ranks.numbered(rows, ["bin"], order).join(F.broadcast(takes), "bin")  # a row for each bin
    return rows.select(subject, ratio, "bin", (F.col("_i") <= F.col("take")).alias("chosen"))


def leave_one_out(subjects: DataFrame, subject: str, seed: int = 5101) -> DataFrame:
    """(evaluated, subject, role): for each subject the others, by digest, one half reference and one half calibration.

    Subjects are few next to their rows; every subject's fold names all others by definition.
    """
    a, b = subjects.select(F.col(subject).alias("evaluated")), subjects.select(F.col(subject).alias("subject"))
    pairs = a.join(b, F.col("evaluated") != F.col("subject"))
    w = Window.partitionBy("evaluated").orderBy(digest(str(seed), F.col("evaluated"), F.col("subject")), "subject")
    n = F.count("*").over(Window.partitionBy("evaluated"))
    return pairs.withColumn("role", F.when(F.row_number().over(w) <= F.floor(n / 2), "reference").otherwise("calibration"))


def quota_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows where there are as many: at least one of each stratum and in proportion, each stratum's first by digest; what
    rounding down leaves comes from the largest stratum (of equal ones the first by name). A sampling operator."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))  # a row for each stratum
    every = Window.partitionBy()
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_n") / F.sum("_n").over(every)))
    sizes = sizes.withColumn("_q", quota).withColumns({"_left": F.greatest(F.lit(n) - F.sum("_q").over(every), F.lit(0)), "_place": F.row_number().over(every.orderBy(F.desc("_n"), stratum))})
    quota = sizes.select(stratum, (F.col("_q") + F.when(F.col("_place") == 1, F.col("_left")).otherwise(0)).alias("_q"))
    rows = ranks.numbered(df, [stratum], [digest(str(seed), F.col(key)), F.col(key)])
    return rows.join(quota, stratum).where("_i <= _q").select(df.columns)


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance, by one aggregate; as large as the columns are many."""
    n = len(columns)
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_samp(a, b) for a in columns for b in columns]).first()
    return np.array(row[:n], float), np.array(row[n:], float).reshape(n, n)


def coral(df: DataFrame, columns: list[str], source: tuple[np.ndarray, np.ndarray], target: tuple[np.ndarray, np.ndarray], eps: float = 1e-6) -> DataFrame:
    """Columns of the source's domain moved to the target's mean and covariance, as an affine map of literals."""

    def root(c: np.ndarray, power: float) -> np.ndarray:
        values, vectors = np.linalg.eigh((c + c.T) / 2 + eps * np.eye(len(c)))
        return (vectors * np.maximum(values, eps) ** power) @ vectors.T

    (ms, cs), (mt, ct) = source, target
    a = root(cs, -0.5) @ root(ct, 0.5)
    moved = [sum(((F.col(c) - float(ms[i])) * float(a[i, j]) for i, c in enumerate(columns)), F.lit(float(mt[j]))) for j in range(len(columns))]
    return df.withColumns(dict(zip(columns, moved, strict=True)))


def over_baseline(windows: DataFrame, baseline: DataFrame, by: list[str], features: str, base: str) -> DataFrame:
    """windows with each feature divided by the baseline vector of its group; null where that is 0 or missing."""
    out = windows.join(baseline.select(*by, base), by, "left")
    return out.withColumn(features, ratio(F.col(features), F.coalesce(F.col(base), F.array()))).drop(base)
