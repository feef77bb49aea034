"""Metrics and audits of decisions, evidence and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import text as T
from relspark.operators import cascade
from relspark.operators.graph import connected_components
from relspark.operators.metrics import count, safe
from relspark.operators.stats import pearson

STATES = ["DATA_INVALID", "OOD_OR_UNCERTAIN", "RELIABLE_LOW", "MONITOR", "RELIABLE_ELEVATED"]
#: Licences that stand for none, stripped and in lower case. Fixed values.
UNRESOLVED = ["", "unknown", "none", "unlicensed", "runtime-source-metadata-unavailable"]
#: Crisis language at run time, on lower-case text with single spaces. Fixed value.
RUNTIME_CRISIS = r"\bsuicid(?:e|al)\b|\bkill myself\b|\bend my life\b|\bhurt myself\b|\bself[ -]?harm\b"


def accepted() -> Column:
    return F.col("state").isin("RELIABLE_LOW", "RELIABLE_ELEVATED")


def policy_metrics(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """Rows, a count for each state, coverage, selective risk (0 if nothing is accepted), how often the prediction set holds
    the label, and how often it has one member, by group. Columns read: state, prediction_set (null: none was formed)."""
    has_set = F.col("prediction_set").isNotNull()
    right = F.array_contains("prediction_set", F.when(F.col(y) == 1, "stress").otherwise("nonstress"))
    wrong = accepted() & ((F.col("state") == "RELIABLE_ELEVATED").cast("int") != F.col(y))
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), *[count(F.col("state") == s).alias(s.lower()) for s in STATES], count(accepted()).alias("accepted"), count(wrong).alias("wrong"),
        count(has_set).alias("sets"), count(has_set & right).alias("hits"), count(has_set & (F.size("prediction_set") == 1)).alias("singletons"),
    )
    return out.withColumns({"coverage": safe(F.col("accepted"), F.col("n")), "risk": safe(F.col("wrong"), F.col("accepted")), "set_coverage": safe(F.col("hits"), F.col("sets")), "singleton_rate": safe(F.col("singletons"), F.col("sets"))}).drop("hits", "singletons")


def policy_methods(df: DataFrame, y: str, by: list[str]) -> DataFrame:
    """Five ways to decide, from the bare score to the whole cascade: n, accepted, tp, fp, wrong, coverage, risk and false positives.

    Columns read: probability, calibrated_probability, ood_ok (valid and in domain), selective_ok (all gates passed), state.
    """
    raw, calibrated = F.coalesce(F.col("probability") >= 0.5, F.lit(False)), F.coalesce(F.col("calibrated_probability") >= 0.5, F.lit(False))
    ways = {
        "raw_0.5": (raw, F.lit(True)), "calibrated": (calibrated, F.lit(True)), "quality_ood": (calibrated, F.col("ood_ok")), "selective": (calibrated, F.col("selective_ok")),
        "full_temporal": (F.col("state") == "RELIABLE_ELEVATED", accepted()),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("method"), hit.alias("hit"), ok.alias("ok")) for n, (hit, ok) in ways.items()]))
    pos, hit, ok = F.col(y) == 1, F.col("hit"), F.col("ok")
    out = df.select(*by, y, rows).groupBy(*by, "method").agg(F.count("*").alias("n"), count(ok).alias("accepted"), count(ok & hit & pos).alias("tp"), count(ok & hit & ~pos).alias("fp"), count(ok & (hit != pos)).alias("wrong"))
    return out.withColumns({"coverage": safe(F.col("accepted"), F.col("n")), "risk": safe(F.col("wrong"), F.col("accepted"), None)})


def corruptions(df: DataFrame, policy: cascade.Policy) -> DataFrame:
    """(corruption, n, rejected, rate): rows whose first feature is made NaN, whose features are multiplied by 50, or whose
    feature order is wrong, through the gates; rejected are invalid and uncertain ones."""
    x = F.col("features")
    nan = F.transform(x, lambda v, i: F.when(i == 0, F.lit(float("nan"))).otherwise(v))
    cases = {"nonfinite": (nan, True), "extreme": (F.transform(x, lambda v: v * 50.0), True), "feature_order": (x, False)}
    kinds = F.inline(F.array(*[F.struct(F.lit(n).alias("corruption"), v.alias("_x"), F.lit(ok).alias("feature_order_ok")) for n, (v, ok) in cases.items()]))
    rows = df.select("*", kinds).withColumn("features", F.col("_x")).drop("_x")
    out = cascade.gates(rows, policy).groupBy("corruption").agg(F.count("*").alias("n"), count(F.col("state").isin("DATA_INVALID", "OOD_OR_UNCERTAIN")).alias("rejected"))
    return out.withColumn("rate", safe(F.col("rejected"), F.col("n")))


def reward_audit(df: DataFrame, reward: str, words: str, safe_flag: str, by: list[str]) -> DataFrame:
    """Mean reward, its correlation with length, unsafe completions of a reward of 0.75 or more, and whether the audit passes."""
    unsafe = (F.col(reward) >= 0.75) & ~F.coalesce(F.col(safe_flag), F.lit(True))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(reward).alias("mean_reward"), pearson(F.col(words).cast("double"), F.col(reward)).alias("correlation"), count(unsafe).alias("unsafe_high"))
    return out.withColumn("passed", (F.col("unsafe_high") == 0) & (F.abs("correlation") < 0.5))


def compare_reports(reports: DataFrame) -> DataFrame:
    """One row: grpo against sft, and whether to deploy it. reports: model (base, sft, grpo, each once), mean_reward,
    citation_accuracy, policy_accuracy, violation_rate, gate. Raises if a model is missing or repeated."""
    names = sorted(r.model for r in reports.select("model").limit(4).collect())
    if names != ["base", "grpo", "sft"]:
        raise ValueError("reports must be exactly base, sft and grpo")
    of = lambda model, c: F.max(F.when(F.col("model") == model, F.col(c)))
    delta = lambda c: of("grpo", c) - of("sft", c)
    out = reports.agg(delta("mean_reward").alias("reward_delta"), delta("citation_accuracy").alias("citation_delta"), delta("policy_accuracy").alias("policy_delta"), (delta("violation_rate") <= 0).alias("safety_not_worse"), of("grpo", "gate").alias("gate"))
    return out.withColumn("deploy", F.col("safety_not_worse") & (F.col("reward_delta") > 0) & F.coalesce(F.col("gate"), F.lit(False)))


def evidence_filter(evidence: Column, least: float) -> tuple[Column, Column]:
    """(accepted evidence, reason). evidence: array of structs with score and license; null or empty is insufficient.

    What scores too low or has no resolved licence goes. If nothing is left, the reason says whether a licence was missing.
    """
    unresolved = lambda e: F.lower(F.regexp_replace(F.coalesce(e["license"], F.lit("")), r"^\s+|\s+$", "")).isin(UNRESOLVED)
    kept = F.filter(evidence, lambda e: (e["score"] >= least) & ~unresolved(e))
    n = F.coalesce(F.size(kept), F.lit(0))
    reason = F.when((n <= 0) & F.coalesce(F.exists(evidence, unresolved), F.lit(False)), "EVIDENCE_LICENSE_UNRESOLVED").when(n <= 0, "EVIDENCE_INSUFFICIENT").when(n < F.size(evidence), "EVIDENCE_FILTERED")
    return kept, reason


def runtime_crisis(t: Column) -> Column:
    return T.has(T.squash(F.lower(F.coalesce(t, F.lit("")))), RUNTIME_CRISIS)


def merged_groups(members: DataFrame, key: str, group: str, near: DataFrame) -> DataFrame:
    """(key, cluster): members of one group, and what edges (a, b) of near texts join, share the smallest key.

    A null group is the member alone. A group is an edge of each member to its smallest, so large groups aren't paired.
    """
    least = members.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias("a"))
    edges = members.join(least, group).select("a", F.col(key).alias("b")).unionByName(near.select("a", "b"))
    found = connected_components(edges).select(F.col("node").alias(key), "component")
    return members.select(key).distinct().join(found, key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def paired(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows of both by their place, each once on either side; reading the rows raises where a place lacks its partner or repeats.

    One full outer join: what doesn't pair is found as it is read, without counting either input.
    """
    sides = [df.groupBy(place).agg(F.count("*").alias(f"_n{i}"), F.first(F.struct(*[c for c in df.columns if c != place])).alias(f"_r{i}")) if len(df.columns) > 1 else df.groupBy(place).agg(F.count("*").alias(f"_n{i}")) for i, df in enumerate((left, right))]
    out = sides[0].join(sides[1], place, "full")
    wrong = (F.coalesce("_n0", F.lit(0)) != 1) | (F.coalesce("_n1", F.lit(0)) != 1)
    out = out.where(F.when(wrong, F.raise_error(F.concat(F.lit("doesn't pair: "), F.col(place).cast("string"))).cast("boolean")).otherwise(True))
    return out.select(place, *[f"_r{i}.*" for i in range(2) if f"_r{i}" in out.columns])
