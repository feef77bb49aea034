"""Signals: variability of beat intervals, the triangular index, peaks, and resampling by a polyphase filter.

Long signals are rows (series, position, value) and are dealt into chunks of positions that overlap by what a result at a
border needs, so that a series of any length is many groups and results have no seams.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.operators import ranks

#: Intervals further apart than this count as a pair (seconds), least number of intervals.
APART, LEAST = 0.05, 3
#: Fixed values of the filter: zero crossings of the sinc on either side, Kaiser's beta.
CROSSINGS, BETA = 10, 5.0
PULSE = ["rate_mean", "rate_sd", "tinn", "triangular_index", "nn50", "pnn50", "rr_mean", "rr_sd", "rms", "freq_mean", "freq_sd", "power_sum"]
#: Most numbers of a batch of windows' density matrices.
STRIP = 1 << 21


def pairs_apart(x: np.ndarray, row: np.ndarray, starts: np.ndarray, least: float = APART) -> np.ndarray:
    """Ordered pairs of a row's values that lie more than `least` apart. x ascends within rows; starts: where each row begins.

    For each value the smaller ones that are far enough away come first: their number is bisected for all values at once.
    """
    low, high = starts[row].copy(), np.arange(len(x))
    begin = low.copy()
    while len(some := np.flatnonzero(low < high)):
        middle = (low[some] + high[some]) // 2
        far = x[some] - x[middle] > least
        low[some[far]], high[some[~far]] = middle[far] + 1, middle[~far]
    return 2 * np.bincount(row, low - begin, len(starts)).astype(np.int64)


def foot_errors(density: np.ndarray) -> np.ndarray:
    """For each place before the last: how far a line that rises from there to the last value lies from the density.

    Below its foot the line is 0. The distance is the norm of the means of neighbouring squared differences.
    """
    top = len(density) - 1
    foot = np.arange(top)[:, None]
    line = density[-1] * np.clip((np.arange(top + 1) - foot) / (top - foot), 0, None)
    square = (density - line) ** 2
    return np.sqrt((((square[:, 1:] + square[:, :-1]) / 2) ** 2).sum(axis=1))


def triangles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, index) of the triangle that fits the density of each row's values best; NaN where the density has no two sides.

    The density is a Gaussian kernel's (Scott's rule) on as many even places as there are values, from the least to the greatest;
    the triangle's top is the density's, its feet are chosen each on its own; index: values over the density at the top.
    """
    n = x.shape[1]
    base, index = np.full(len(x), np.nan), np.full(len(x), np.nan)
    width = x.std(axis=1, ddof=1) * n**-0.2
    for at in range(0, len(x), max(1, STRIP // (n * n))):
        rows = np.flatnonzero(width[at : at + max(1, STRIP // (n * n))] > 0) + at
        places = np.linspace(x[rows].min(axis=1), x[rows].max(axis=1), n, axis=1)
        z = (places[:, :, None] - x[rows][:, None, :]) / width[rows, None, None]
        density = np.exp(-0.5 * z * z).sum(axis=2) / (n * width[rows, None] * np.sqrt(2 * np.pi))
        for r, place, y in zip(rows, places, density, strict=True):
            top = int(y.argmax())
            if 0 < top < n - 1:
                left = int(foot_errors(y[: top + 1]).argmin())
                right = top + 1 + int(foot_errors(y[: top - 1 if top else None : -1])[::-1].argmin())  # of equals the nearest to the top
                base[r], index[r] = (right - left) * (place[-1] - place[0]) / (n - 1), n / y[top]
    return base, index


def spectra(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the frequencies below half the mean rate, and the sum of their amplitudes, of rows of one length."""
    n, mean = x.shape[1], x.mean(axis=1)
    amplitude = 2 / n * np.abs(np.fft.rfft(x - mean[:, None], axis=1))[:, : n // 2]
    steps = np.arange(n // 2)
    return steps.mean() / (n * mean), steps.std() / (n * mean), amplitude.sum(axis=1)


def means(x: np.ndarray) -> np.ndarray:
    """Mean of each row, added up one after the other as SQL does: of values with few decimals it often lies between two roundings."""
    return np.cumsum(x, axis=1)[:, -1] / x.shape[1]


def pulse_arrays(intervals: list[np.ndarray]) -> tuple[np.ndarray, list[str | None]]:
    """PULSE features (rows, 12) of lists of intervals, NaN where there is a problem, and the problems."""
    out, problem = np.full((len(intervals), len(PULSE)), np.nan), ["TOO_FEW_INTERVALS"] * len(intervals)
    good = [i for i, v in enumerate(intervals) if len(v) >= LEAST and (v > 0).all() and np.isfinite(v).all()]
    sizes = np.array([len(intervals[i]) for i in good])
    for n in np.unique(sizes):
        rows = np.array(good)[sizes == n]
        x = np.stack([intervals[i] for i in rows])
        flat = np.sort(x, axis=1).ravel()
        near = np.maximum(pairs_apart(flat, np.repeat(np.arange(len(x)), n), n * np.arange(len(x))), 1)
        rate = 1 / x
        out[rows] = np.stack([rate.mean(axis=1), rate.std(axis=1), *triangles(x), near, near / n**2, means(x), x.std(axis=1), np.sqrt((x * x).mean(axis=1)), *spectra(x)], axis=1)
    for i in good:
        problem[i] = None if np.isfinite(out[i]).all() else "TOO_LITTLE_VARIATION"
        if problem[i]:
            out[i] = np.nan
    return out, problem


def pulse_features(df: DataFrame, intervals: str) -> DataFrame:
    """df with the twelve PULSE features of an array of beat intervals in seconds, and `problem`.

    rms is the root of the mean square, nn50 counts ordered pairs of any two intervals (1 at least), pnn50 is it over n * n.
    Null arrays, fewer than three intervals, intervals that are null, not finite or not above 0: all features null, problem
    TOO_FEW_INTERVALS; a density without two sides (equal intervals): TOO_LITTLE_VARIATION. A window is one row of one task.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.array([np.nan if x is None else x for x in v or []], float) for v in b.column(intervals).to_pylist()]
            found, problem = pulse_arrays(lists)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, i], mask=np.isnan(found[:, i])) for i in range(len(PULSE))), pa.array(problem, pa.string())], names=[*b.schema.names, *PULSE, "problem"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(features, ", ".join([*fields, *(f"{c} double" for c in PULSE), "problem string"]))


def in_chunks(df: DataFrame, position: str, size: int, overlap: int) -> DataFrame:
    """df with chunk and own: rows also go to the chunks whose range of positions they lie within `overlap` of, as not own."""
    p = F.col(position)
    reach = F.sequence(F.floor((p - overlap) / size), F.floor((p + overlap) / size))
    out = df.withColumn("chunk", F.explode(reach)).where("chunk >= 0")
    return out.withColumn("own", F.floor(p / size) == F.col("chunk"))


def smoothed(df: DataFrame, by: list[str], position: str, value: Column, half: int = 2, size: int = 1 << 16) -> DataFrame:
    """df with chunk, smooth, the mean of 2 * half + 1 neighbouring positions (places without a row or value count as zeros), and near, its values."""
    dealt = in_chunks(df.withColumn("_v", value), position, size, half)
    near = Window.partitionBy(*by, "chunk").orderBy(position).rangeBetween(-half, half)
    dealt = dealt.withColumns({"smooth": F.coalesce(F.sum("_v").over(near), F.lit(0.0)) / (2 * half + 1), "near": F.count("_v").over(near)})
    return dealt.where("own").drop("own", "_v")


def peaks(df: DataFrame, by: list[str], position: str, value: str, threshold: float, size: int = 1 << 16) -> DataFrame:
    """(by..., peak, height): of each run of the smoothed standardised signal above its mean the first greatest position.

    Rows are taken in order of position (of one position by value), neighbours are rows: gaps between positions don't count. A row
    without a value is a place that adds nothing; a place without a value within reach lies in no run. A run ends where the signal
    falls below the mean, not where it only meets it; only heights above the threshold count. Runs are numbered by chunk and then
    by the chunks before (a row for each chunk), so that a series' rows never meet in one task. A constant series has no peaks. Rows
    without a position are left out.

    Values are summed before they are standardised, and sums are rounded to about 11 digits of the series' scale (by a power of ten): equal sums
    of decimals are equal heights, whatever the order of a sum and the mean's last bits.
    """
    df = df.where(F.col(position).isNotNull()).select(*by, F.col(position).alias("_at"), F.col(value).cast("double").alias("_x"))
    moments = df.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_sd")).where("_sd > 0")
    places = ranks.numbered(df, by, [F.col("_at"), F.col("_x")]).withColumn("_i", F.col("_i") - 1)
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("_mean") + F.col("_sd"))) - 11)
    places = smoothed(places, by, "_i", F.col("_x"), size=size).where("near > 0").join(moments, by)
    total = F.rint(F.col("smooth") * 5 / step) * step
    smooth = places.select(*by, "_i", "_at", "chunk", ((total - F.col("near") * F.col("_mean")) / F.col("_sd") / 5).alias("smooth"))
    base = smooth.groupBy(*by).agg(F.avg("smooth").alias("_base"))
    rows = smooth.join(base, by)
    below = (F.col("smooth") < F.col("_base")).cast("long")
    before = rows.groupBy(*by, "chunk").agg(F.sum(below).alias("_n"))
    before = before.select(*by, "chunk", (F.sum("_n").over(Window.partitionBy(*by).orderBy("chunk")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_in", F.sum(below).over(Window.partitionBy(*by, "chunk").orderBy("_i"))).where("smooth > _base").join(before, [*by, "chunk"])
    runs = rows.groupBy(*by, (F.col("_in") + F.col("_before")).alias("_run")).agg(F.max(F.struct("smooth", (-F.col("_i")).alias("i"), F.col("_at").alias("p"))).alias("_top"))
    return runs.where(F.col("_top.smooth") > threshold).select(*by, F.col("_top.p").alias("peak"), F.col("_top.smooth").alias("height"))


def filter_bank(up: int, down: int) -> tuple[np.ndarray, int]:
    """(up, taps) coefficients of a low-pass sinc under a Kaiser window, one row for each phase, and half the filter's length.

    The sum of the whole filter is `up`, so that a constant stays one.
    """
    most = max(up, down)
    half = CROSSINGS * most
    h = np.sinc(np.arange(-half, half + 1) / most) * np.kaiser(2 * half + 1, BETA)
    h *= up / h.sum()
    padded = np.concatenate((h, np.zeros(-len(h) % up)))
    return padded.reshape(-1, up).T, half


def resample(x: np.ndarray, up: int, down: int, first: int = 0, outputs: tuple[int, int] | None = None) -> np.ndarray:
    """Outputs (from, to) of the signal at up / down times its rate; x begins at position `first`, elsewhere it is 0."""
    bank, half = filter_bank(up, down)
    start, end = outputs or (0, -(-len(x) * up // down))
    at = np.arange(start, end) * down + half  # in the finer grid, h[0] meets x at the last place not after it
    phase, last = at % up, at // up - first
    taps = last[:, None] - np.arange(bank.shape[1])
    inside = (taps >= 0) & (taps < len(x))
    return (np.where(inside, x[np.clip(taps, 0, max(0, len(x) - 1))], 0.0) * bank[phase]).sum(axis=1) if len(x) else np.zeros(end - start)


def resampled(df: DataFrame, by: list[str], position: str, value: str, source: int, target: int, size: int = 1 << 14) -> DataFrame:
    """(by..., position, value) of each series at another rate, from positions 0 to ceil(n * target / source) - 1.

    n is the greatest position plus 1; missing positions, nulls and what lies outside are 0, rows with a negative or no
    position are left out. Equal rates give the rows as they are. Rows of one position add up.
    """
    up, down = target // gcd(source, target), source // gcd(source, target)
    rows = df.where(F.col(position) >= 0).select(*by, F.col(position).cast("long").alias("_p"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"))
    if up == down:
        return rows.select(*by, F.col("_p").alias(position), F.col("_x").alias(value))
    reach = filter_bank(up, down)[1] // up + 2
    lengths = rows.groupBy(*by).agg((F.max("_p") + 1).alias("_n"))
    chunks = in_chunks(rows, "_p", size, reach).groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_s"))  # size + 2 * reach rows
    # A chunk without own rows still has outputs: all chunks up to the last are there where any row is near; others are 0.
    every = lengths.select(*by, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size))).alias("chunk"))
    chunks = every.join(chunks, [*by, "chunk"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c) for c in by]
            for i, (n, c, s) in enumerate(zip(b.column("_n").to_pylist(), b.column("chunk").to_pylist(), b.column("_s").to_pylist(), strict=True)):
                first = c * size - reach
                x = np.zeros(size + 2 * reach)
                np.add.at(x, np.array([r["_p"] - first for r in s or []], int), [r["_x"] for r in s or []])
                start, end = -(-c * size * up // down), -(-min(n, (c + 1) * size) * up // down)
                y = resample(x, up, down, first, (start, end))
                same = pa.array(np.full(len(y), i))
                yield pa.RecordBatch.from_arrays([*(k.take(same) for k in columns), pa.array(np.arange(start, end)), pa.array(y)], names=[*by, "_p", "_y"])

    out = chunks.mapInArrow(filtered, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_p long", "_y double"]))
    return out.select(*by, F.col("_p").alias(position), F.col("_y").alias(value))
