"""Reports on ways to decide: metrics of what each accepts, by subject and over all, and how unlike subjects are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.operators import metrics
from relspark.operators.metrics import count, safe
from relspark.operators.storage import written

#: Metrics whose mean over subjects is reported.
MACRO = ["accuracy", "f1", "coverage", "risk", "auroc", "ece", "false_alerts_per_hour"]


def method_metrics(df: DataFrame, y: str, by: list[str], window_seconds: float) -> DataFrame:
    """Metrics of the accepted rows by group: df has score, hit (the decision), ok (accepted), alert and the label y in 0, 1.

    n, accepted, abstained, coverage; tp, fp, tn, fn, accuracy, precision, recall, f1 and risk (1 - accuracy) of the accepted part, risk null
    if nothing is accepted; auroc of it (null where a class is missing), nll, brier and ece of it (null without rows); alerts, false alerts,
    hours observed (all rows, a window each) and false alerts an hour. Null flags count as false. A group in which nothing is
    accepted has its row.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = df.withColumns({"ok": flag("ok"), "hit": flag("hit"), "alert": flag("alert")})
    pos = F.col(y) == 1
    cells = [("tp", F.col("hit") & pos), ("fp", F.col("hit") & ~pos), ("tn", ~F.col("hit") & ~pos), ("fn", ~F.col("hit") & pos)]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), count(F.col("ok")).alias("accepted"), *[count(F.col("ok") & c).alias(name) for name, c in cells], count(F.col("alert")).alias("alerts"), count(F.col("alert") & ~pos).alias("false_alerts"))
    tp, fp, tn, fn, kept = (F.col(c) for c in ("tp", "fp", "tn", "fn", "accepted"))
    out = out.withColumns({"abstained": F.col("n") - kept, "coverage": safe(kept, F.col("n")), "accuracy": safe(tp + tn, kept), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    hours = F.col("n") * F.lit(window_seconds / 3600.0)
    out = out.withColumns({"f1": safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "risk": F.when(kept > 0, 1 - F.col("accuracy")), "hours": hours, "false_alerts_per_hour": safe(F.col("false_alerts"), hours, None)})
    inside = rows.where("ok AND score IS NOT NULL")
    auroc = metrics.auroc(inside, y, "score", by).select(*by, "auroc")
    calibration = metrics.calibration(inside, y, "score", by=by).select(*by, "nll", "brier", "ece")
    return out.join(auroc, by, "left").join(calibration, by, "left")


def aggregate(df: DataFrame, y: str, method: str, subject: str, window_seconds: float, reference: str) -> tuple[DataFrame, DataFrame]:
    """(by method, by method and subject). By method: the metrics of all rows, macro_<metric> (means over subjects, nulls skipped),
    how unlike subjects are (least, median, greatest coverage, subjects covered below one half, their names), and against the method
    `reference` how many subjects have a lower risk, and the change of risk and of false alerts an hour.

    Subjects are few beside their rows: a method's are gathered once. A null subject is one.
    """
    each = written(method_metrics(df, y, [method, subject], window_seconds), "subjects")
    means = [F.avg(c).alias(f"macro_{c}") for c in MACRO]
    low = F.col("coverage") < 0.5
    spread = each.groupBy(method).agg(F.count("*").alias("subjects"), *means, F.min("coverage").alias("least_coverage"), F.percentile("coverage", 0.5).alias("median_coverage"), F.max("coverage").alias("greatest_coverage"), count(low).alias("below_half"), F.array_join(F.array_sort(F.collect_list(F.when(low, F.col(subject).cast("string")))), ",").alias("below_half_subjects"))
    base = each.where(F.col(method) == reference).select(F.col(subject).alias("_s"), F.col("risk").alias("_r"))
    better = each.join(base, F.col(subject).eqNullSafe(F.col("_s"))).groupBy(method).agg(count(F.col("risk") < F.col("_r")).alias("improved_subjects"))
    pooled = method_metrics(df, y, [method], window_seconds)
    of = pooled.where(F.col(method) == reference).select(F.col("risk").alias("_risk"), F.col("false_alerts_per_hour").alias("_alerts"))
    out = pooled.join(spread, method).join(better, method, "left").join(F.broadcast(of), F.lit(True), "left")  # one row
    deltas = {"risk_change": F.col("risk") - F.col("_risk"), "alerts_change": F.col("false_alerts_per_hour") - F.col("_alerts"), "improved_subjects": F.coalesce("improved_subjects", F.lit(0))}
    return out.withColumns(deltas).drop("_risk", "_alerts"), each


def completion_report(df: DataFrame, by: list[str], least_parsed: float = 0.99) -> DataFrame:
    """Completions by group: rows, schema_parse_rate, policy_accuracy, violation_rate, citation_accuracy, mean_reward, mean_words, gate.

    df has candidate and code (as canonical.candidate gives them), target, evidence_ids, hard_safety (passed), reward and words. Only a
    reply that is read can be right; it cites rightly if all it cites is at hand, citing nothing included. The gate is open at the
    least parse rate without a violation. Null flags count as false, null evidence as none.
    """
    none = F.array().cast("array<string>")
    parsed = F.col("code").isNull() & F.col("candidate").isNotNull()
    right = parsed & (F.col("candidate.policy_target") == F.col("target"))
    cites = parsed & (F.size(F.array_except(F.coalesce("candidate.evidence_ids", none), F.coalesce("evidence_ids", none))) == 0)
    broken = ~F.coalesce(F.col("hard_safety"), F.lit(False))
    share = lambda c: safe(count(c), F.count("*"))
    rates: dict[str, Column] = {"schema_parse_rate": share(parsed), "policy_accuracy": share(right), "violation_rate": share(broken), "citation_accuracy": share(cites), "mean_reward": F.avg("reward"), "mean_words": F.avg("words")}
    out = df.groupBy(*by).agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in rates.items()], count(broken).alias("_v"))
    return out.withColumn("gate", reduce(lambda a, b: a & b, [F.col("schema_parse_rate") >= least_parsed, F.col("_v") == 0])).drop("_v")
