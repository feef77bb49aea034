"""Metrics of probabilities and decisions, each a few aggregates over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.functions.numeric import clip_probability
from relspark.operators import ranks


def safe(n: Column, d: Column, default: float | None = 0.0) -> Column:
    """n / d, or the default where d is 0."""
    return F.when(d == 0, F.lit(default)).otherwise(n / F.when(d != 0, d))


def count(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def nll(y: Column, p: Column) -> Column:
    p = clip_probability(p)
    return F.avg(-(y * F.log(p) + (1 - y) * F.log1p(-p)))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def bin_of(p: Column, bins: int) -> Column:
    """Index of p among equal bins closed on the right; 0 lies in the first."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < p))


def reliability_bins(df: DataFrame, y: str, p: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows, mean probability and share of ones by bin; empty bins are left out."""
    keys = by or []
    return df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 15, by: list[str] | None = None) -> DataFrame:
    """n, nll, brier and ece, in one shuffle of bin sums."""
    keys = by or []
    clipped = clip_probability(F.col(p))
    loss = -(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log1p(-clipped))
    cells = df.groupBy(*keys, bin_of(F.col(p), bins).alias("_bin")).agg(F.count("*").alias("_n"), F.sum(p).alias("_p"), F.sum(y).alias("_y"), F.sum(loss).alias("_l"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("_b"))
    n = F.sum("_n")
    return cells.groupBy(*keys).agg(n.alias("n"), (F.sum("_l") / n).alias("nll"), (F.sum("_b") / n).alias("brier"), (F.sum(F.abs(F.col("_p") - F.col("_y"))) / n).alias("ece"))


def confusion(df: DataFrame, y: str, predicted: Column, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall and f1 by group; ratios without a base are 0."""
    pos = F.col(y) == 1
    out = df.withColumn("_hit", predicted).groupBy(*by).agg(*[count(c).alias(n) for n, c in (("tp", F.col("_hit") & pos), ("fp", F.col("_hit") & ~pos), ("tn", ~F.col("_hit") & ~pos), ("fn", ~F.col("_hit") & pos))])
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns({"accuracy": safe(tp + tn, tp + fp + tn + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def auroc(df: DataFrame, y: str, p: str, by: list[str], default: float | None = None) -> DataFrame:
    """Area under the ROC curve by group; `default` where a class is missing.

    Rows are first summed by score and ties count one half; scores are counted in ranges, so that a group is never in one task.
    """
    cells = df.groupBy(*by, p).agg(F.count("*").alias("_n"), F.sum(y).cast("long").alias("_y"))
    cells = ranks.running(cells, by, [F.col(p)], {"_upto": F.col("_n") - F.col("_y")})
    cells = cells.withColumn("_wins", F.col("_y") * (F.col("_upto") - (F.col("_n") - F.col("_y")) / 2.0))
    ones, all_ = F.sum("_y"), F.sum("_n")
    out = cells.groupBy(*by).agg(F.sum("_wins").alias("_w"), ones.alias("positives"), (all_ - ones).alias("negatives"))
    return out.select(*by, "positives", "negatives", safe(F.col("_w"), F.col("positives") * F.col("negatives"), default).alias("auroc"))


def aurc(df: DataFrame, wrong: str, confidence: str, tie: str, by: list[str]) -> DataFrame:
    """Area under the risk-coverage curve by group, by trapezoids; equal confidences in the order of `tie`."""
    curve = ranks.running(df.select(*by, F.col(wrong).cast("double").alias("_x"), F.col(confidence).alias("_c"), F.col(tie).alias("_t")), by, [F.desc("_c"), F.asc("_t")], {"_w": F.col("_x"), "_k": F.lit(1).cast("long")})
    before = F.when(F.col("_k") > 1, (F.col("_w") - F.col("_x")) / (F.col("_k") - 1))
    curve = curve.withColumns({"_risk": F.col("_w") / F.col("_k"), "_before": before, "_n": F.col("_all__k")})
    return curve.groupBy(*by).agg(F.coalesce(F.sum((F.col("_risk") + F.col("_before")) / 2 / F.col("_n")), F.lit(0.0)).alias("aurc"), F.count("*").alias("n"))


def selective(df: DataFrame, y: str, predicted: str, accepted: str, by: list[str]) -> DataFrame:
    """Rows, accepted, coverage and risk (null if nothing is accepted) by group."""
    wrong = F.col(accepted) & (F.col(predicted).cast("int") != F.col(y))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), count(F.col(accepted)).alias("accepted"), count(wrong).alias("wrong"))
    return out.withColumns({"coverage": safe(F.col("accepted"), F.col("n")), "risk": safe(F.col("wrong"), F.col("accepted"), None)})


def alerts(df: DataFrame, session: str, ts: str, notify: Column, false: Column, by: list[str]) -> DataFrame:
    """Notifications, false ones, hours watched and false ones an hour (null at 0 hours): sessions first, then groups."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 3.6e9
    one = df.groupBy(*by, session).agg(span.alias("h"), count(notify).alias("s"), count(notify & false).alias("f"))
    out = one.groupBy(*by).agg(F.sum("h").alias("hours"), F.sum("s").alias("notifications"), F.sum("f").alias("false_notifications"))
    return out.withColumn("false_per_hour", safe(F.col("false_notifications"), F.col("hours"), None))


def threshold_search(df: DataFrame, y: str, p: str, steps: int = 101) -> DataFrame:
    """f1 at each threshold i / (steps - 1), p >= threshold predicting 1.

    Rows are summed by the last threshold that they reach; a running sum over at most `steps` cells gives every
    confusion matrix, so rows never meet the grid.
    """
    reach = F.floor(F.col(p) * (steps - 1) + 1e-9).cast("int")
    cells = df.groupBy(F.least(F.greatest(reach, F.lit(0)), F.lit(steps - 1)).alias("i")).agg(F.sum(y).cast("long").alias("y"), F.count("*").alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"))
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # over `steps` rows
    full = grid.join(cells, "i", "left").na.fill(0, ["y", "n"])
    full = full.withColumns({"tp": F.sum("y").over(w), "hits": F.sum("n").over(w), "positives": F.sum("y").over(Window.partitionBy())})
    return full.select("i", "tp", (F.col("hits") - F.col("tp")).alias("fp"), safe(2.0 * F.col("tp"), F.col("hits") + F.col("positives")).alias("f1"))


def fold_confusion(df: DataFrame, fold: str, predicted: str, label: Column | str, predictions: list[int], labels: list[int]) -> DataFrame:
    """(predicted, label, mean, std): each cell's share of its fold's rows in per cent, over folds; a cell that a fold lacks is 0 there.

    std is that of the folds at hand, not of a population they were drawn from.
    """
    df = df.select(fold, F.col(predicted).alias("_p"), (F.col(label) if isinstance(label, str) else label).alias("_y"))
    cells = [(p, y) for p in predictions for y in labels]
    folds = df.groupBy(fold).agg(F.count("*").alias("_n"), *[F.count_if((F.col("_p") == p) & (F.col("_y") == y)).alias(f"_c{i}") for i, (p, y) in enumerate(cells)])
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("predicted"), F.lit(y).alias("label"), (100 * F.col(f"_c{i}") / F.col("_n")).alias("pct")) for i, (p, y) in enumerate(cells)]))
    return folds.select(rows).groupBy("predicted", "label").agg(F.avg("pct").alias("mean"), F.stddev_pop("pct").alias("std"))
