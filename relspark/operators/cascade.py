"""The reliability cascade: validity, quality, distance, calibration, conformal set, then decisions over time.

Stateless gates are columns; the first that fails names the state. Only rows that pass all of them enter a session's
history, so the windows' partitions tell those rows from the others. Rows are dealt by session once for all windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import numeric

from . import temporal

# States, what each allows, and the signal checks with their limits.
ACTIONS = {
    "DATA_INVALID": ["retry_sensor", "continue_by_text"],
    "OOD_OR_UNCERTAIN": ["monitor", "ask_user", "continue_by_text"],
    "RELIABLE_ELEVATED": ["monitor", "ask_user", "support", "propose_dry_run"],
    "MONITOR": ["monitor", "ask_user"],
    "RELIABLE_LOW": ["monitor", "continue_by_text"],
}
SIGNALS = [
    ("window_seconds", 20.0, float("inf"), "SIGNAL_WINDOW_TOO_SHORT"),
    ("sampling_rate_hz", 5e-324, float("inf"), "SAMPLING_RATE_INVALID"),
    ("rpeak_success", 0.8, float("inf"), "RPEAK_QUALITY_LOW"),
    ("abnormal_rr_fraction", 0.0, 0.2, "ABNORMAL_RR_HIGH"),
    ("valid_fraction", 0.8, 1.0, "VALID_SEGMENT_LOW"),
    ("flatline_fraction", 0.0, 0.1, "FLATLINE_HIGH"),
    ("saturation_fraction", 0.0, 0.1, "SATURATION_HIGH"),
]


@dataclass(frozen=True)
class Policy:
    """Fitted values and limits, put into the plan as literals."""

    medians: list[float]
    scales: list[float]
    centers: list[float]
    spreads: list[float]
    ood_threshold: float
    conformal_quantile: float
    model_id: str = "model"
    slope: float = 1.0
    intercept: float = 0.0
    soft_z: float = 6.0
    hard_z: float = 30.0
    least_external: float = 0.5
    least_confidence: float = 0.6
    on: float = 0.65
    off: float = 0.45
    k: int = 2
    m: int = 3
    cooldown_seconds: float = 900.0
    version_required: bool = False
    signals: list = field(default_factory=lambda: SIGNALS)


def doubles(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def signal_failures(signal: Column, checks: list) -> Column:
    """Codes of the checks that fail, in order; a check without its key is not made."""
    codes = []
    for key, low, high, code in checks:
        v = F.element_at(signal, F.lit(key))
        codes.append(F.when(v.isNotNull() & ~((v >= low) & (v <= high) & ~F.isnan(v)), F.lit(code)))
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def gates(df: DataFrame, policy: Policy) -> DataFrame:
    """df with quality_score, calibrated_probability, prediction_set, state and reasons; state is null where all gates pass.

    Columns read: features (array<double>), probability or logit (exactly one), and, where present, ts_text, model_id,
    feature_order_ok, external_quality, signal_quality (map). Absent columns count as null and aren't checked.
    """
    col = lambda name, kind: F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
    features = F.col("features")
    time_ok = F.expr("ts_text IS NULL OR try_to_timestamp(ts_text) IS NOT NULL") if "ts_text" in df.columns else F.lit(True)
    model_ok = F.coalesce(col("model_id", "string") == policy.model_id, F.lit("model_id" not in df.columns))
    order_ok = F.coalesce(col("feature_order_ok", "boolean"), F.lit(True))
    external = col("external_quality", "double")
    external_bad = external.isNotNull() & ~(numeric.is_finite(external) & (external >= 0) & (external <= 1))
    signal = F.col("signal_quality") if "signal_quality" in df.columns else F.lit(None).cast("map<string,double>")
    n = len(policy.medians)
    count_ok = F.coalesce(F.size(features) == n, F.lit(False))
    z = F.when(count_ok, numeric.robust_z(features, doubles(policy.medians), doubles(policy.scales)))
    p, x = col("probability", "double"), col("logit", "double")
    p = F.when(p.isNotNull() & x.isNull(), p).when(x.isNotNull() & p.isNull(), numeric.sigmoid(x))
    p_ok = F.coalesce(numeric.is_finite(p) & (p >= 0) & (p <= 1), F.lit(False))
    failed = F.coalesce(signal_failures(signal, policy.signals), F.array().cast("array<string>"))
    out = df.withColumns({"_z": z, "_p": p, "_failed": failed})
    distance = F.when(count_ok, numeric.rms_distance(features, doubles(policy.centers), doubles(policy.spreads)))
    calibrated = numeric.platt(numeric.logit(F.col("_p")), policy.slope, policy.intercept)
    finite = F.coalesce(numeric.all_finite(features), F.lit(False))
    no = lambda *codes: F.array(*map(F.lit, codes)) if codes else F.array().cast("array<string>")
    quality = (
        F.when(~count_ok, no("FEATURE_COUNT_INVALID"))
        .when(~finite, no("NONFINITE_FEATURE"))
        .when(external_bad, no("EXTERNAL_QUALITY_INVALID"))
        .when(F.coalesce(external < policy.least_external, F.lit(False)), no("EXTERNAL_QUALITY_LOW"))
        .when(F.size("_failed") > 0, F.col("_failed"))
        .when(F.col("_z") >= policy.hard_z, no("FEATURE_OUT_OF_RANGE"))
    )
    invalid = F.when(~time_ok, no("TIMESTAMP_INVALID")).when(~model_ok, no("MODEL_ID_MISMATCH")).when(~order_ok, no("FEATURE_ORDER_MISMATCH")).otherwise(F.coalesce(quality, F.when(~p_ok, no("PROBABILITY_INVALID"))))
    out = out.withColumns({"_invalid": invalid, "ood_score": distance})
    valid = F.col("_invalid").isNull()
    far = F.col("ood_score") > policy.ood_threshold
    out = out.withColumn("calibrated_probability", F.when(valid, calibrated))
    c = F.col("calibrated_probability")
    inside = [(1 - (1 - c) <= policy.conformal_quantile, "nonstress"), (1 - c <= policy.conformal_quantile, "stress")]
    out = out.withColumn("prediction_set", F.when(valid & ~far, F.filter(F.array(*[F.when(ok, F.lit(name)) for ok, name in inside]), lambda v: v.isNotNull())))
    ambiguous, unsure = F.size("prediction_set") != 1, F.greatest(c, 1 - c) < policy.least_confidence
    doubt = F.concat(no("QUALITY_OK", "IN_DOMAIN"), F.when(ambiguous, no("CONFORMAL_AMBIGUOUS")).otherwise(no()), F.when(unsure, no("CONFIDENCE_LOW")).otherwise(no()))
    state = F.when(~valid, "DATA_INVALID").when(far | ambiguous | unsure, "OOD_OR_UNCERTAIN")
    reasons = F.when(~valid, F.col("_invalid")).when(far, no("QUALITY_OK", "OOD_HIGH")).when(ambiguous | unsure, doubt)
    score = F.when(~valid & ~F.array_contains(F.coalesce("_invalid", no()), "FEATURE_OUT_OF_RANGE"), F.lit(0.0)).otherwise(F.least(numeric.soft_quality(F.col("_z"), policy.soft_z), F.coalesce(external, F.lit(1.0))))
    return out.withColumns({"quality_score": score, "state": state, "reasons": reasons}).drop("_z", "_p", "_failed", "_invalid")


def decide(df: DataFrame, policy: Policy, session: str = "session", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """The cascade: df with its gates, state, allowed actions (in order) and reasons for every row.

    Rows of a session are taken in the order of seq. A row that is earlier than an accepted one is DATA_INVALID and
    leaves no trace. Notifications, which follow from the rows given here, are temporal.notifications().
    """
    out = gates(df, policy).repartition(session).withColumnRenamed("state", "_gate").withColumnRenamed("reasons", "_why")
    out = out.withColumn("_pass", F.col("_gate").isNull())
    out = out.withColumn("_late", F.col("_pass") & temporal.out_of_order([session, "_pass"], seq, ts))
    out = out.withColumn("_live", F.col("_pass") & ~F.col("_late"))
    out = temporal.states(out, [session, "_live"], seq, "calibrated_probability", policy.on, policy.off, policy.k, policy.m)
    was = F.coalesce(F.lag("active").over(temporal.Window.partitionBy(session, "_live").orderBy(seq)), F.lit(False))
    codes = lambda *names: F.array(*map(F.lit, names))
    live = (
        F.when(F.col("state") == "ELEVATED", codes("QUALITY_OK", "IN_DOMAIN", "CONFORMAL_SINGLETON", "HYSTERESIS_ACTIVE", "CALIBRATED_HIGH"))
        .when(F.col("state") == "MONITOR", codes("QUALITY_OK", "IN_DOMAIN", "CONFORMAL_SINGLETON", "HYSTERESIS_PENDING"))
        .when(F.col("_was"), codes("QUALITY_OK", "IN_DOMAIN", "CONFORMAL_SINGLETON", "HYSTERESIS_RELEASED", "CALIBRATED_LOW"))
        .otherwise(codes("QUALITY_OK", "IN_DOMAIN", "CONFORMAL_SINGLETON", "CALIBRATED_LOW"))
    )
    name = F.when(F.col("state") == "ELEVATED", "RELIABLE_ELEVATED").when(F.col("state") == "LOW", "RELIABLE_LOW").otherwise("MONITOR")
    every = out.withColumn("_was", was).withColumns({
        "reasons": F.when(F.col("_live"), live).when(F.col("_late"), codes("TIMESTAMP_OUT_OF_ORDER")).otherwise(F.col("_why")),
        "state": F.when(F.col("_live"), name).when(F.col("_late"), "DATA_INVALID").otherwise(F.col("_gate")),
    }).drop("_gate", "_why", "_pass", "_late", "_live", "_was", "elevated", "active")
    actions = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(",".join(v)))])
    return every.withColumn("allowed_actions", F.element_at(actions, F.col("state")))
