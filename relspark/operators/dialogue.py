"""Conversations: latest turns, training rows, routing, and verification of candidate replies by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.functions import text as T

# Weights of the overall score, codes that no rewrite repairs, targets that a state allows.
WEIGHTS = {"groundedness": 0.25, "policy": 0.20, "consent": 0.15, "personalization": 0.10, "helpfulness": 0.15, "style": 0.05, "format": 0.10}
HARD = ["DIAGNOSTIC_CLAIM", "MEDICATION_INSTRUCTION", "CRISIS_NOT_ESCALATED", "TASKRELIEF_BLOCKED_BY_CRISIS", "TOOL_NOT_ALLOWLISTED", "ACTION_NOT_ALLOWED", "ACTION_NOT_REVERSIBLE", "DECLINE_OR_CANCEL_IGNORED"]
ALLOWED_TARGETS = {
    "DATA_INVALID": ["ASK", "ABSTAIN"],
    "OOD_OR_UNCERTAIN": ["ASK", "ABSTAIN"],
    "MONITOR": ["MONITOR", "ASK"],
    "RELIABLE_LOW": ["MONITOR", "ASK", "SUPPORT"],
    "RELIABLE_ELEVATED": ["SUPPORT", "ASK", "PROPOSE", "CONFIRM"],
}
ALWAYS_ALLOWED = ["ESCALATE", "ABSTAIN", "REFINE", "CONFIRM"]


def latest(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Latest user and assistant texts, the number of user turns, and all user texts in order, by conversation."""
    of = lambda r: F.max_by(F.when(F.col(role) == r, F.col(text)), F.when(F.col(role) == r, F.col(turn)))
    mine = F.when(F.col(role) == "user", F.struct(F.col(turn).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(mine)), lambda s: s["x"]), " ")  # a conversation's own turns
    return df.groupBy(conversation).agg(of("user").alias("last_user"), of("assistant").alias("last_assistant"), F.count(mine).alias("user_turns"), said.alias("user_text"))


def training_rows(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, turn, target, context_turns): each assistant turn with the number of turns before it."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("context_turns", F.count("*").over(w)).where(F.col(role) == "assistant").select(conversation, turn, F.col(text).alias("target"), "context_turns")


def expected_target(user_text: Column, state: Column, awaiting: Column, stressor: Column, may_propose: Column) -> Column:
    """What a reply should do: crisis first, then what is refused, then the answer awaited, then the state."""
    answer = T.consent(user_text)
    replied = F.when(answer == "yes", "CONFIRM").when(answer.isin("no", "refine"), "REFINE").when(answer == "cancel", "MONITOR").otherwise("ASK")
    return (
        F.when(T.has(user_text, T.CRISIS), "ESCALATE")
        .when(T.has(user_text, T.INJECTION) | T.has(user_text, T.MEDICAL_REQUEST), "ABSTAIN")
        .when(awaiting, replied)
        .when(state.isin("DATA_INVALID", "OOD_OR_UNCERTAIN"), "ASK")
        .when(state == "MONITOR", "MONITOR")
        .when((state == "RELIABLE_ELEVATED") & stressor & may_propose, "PROPOSE")
        .otherwise("SUPPORT")
    )


def state_allows(state: Column, target: Column) -> Column:
    fits = F.lit(False)
    for s, targets in ALLOWED_TARGETS.items():
        fits = fits | ((state == s) & target.isin(targets))
    return fits | target.isin(ALWAYS_ALLOWED)


def grounding(response: Column, evidence: Column, cited: Column) -> tuple[Column, Column]:
    """(score, code or null). evidence: map from id to text, cited: ids. Words shared with what is cited support a reply."""
    ids = F.map_keys(evidence)
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9']+)"), 1))
    content = F.array_except(words(response), F.array(*map(F.lit, T.STOP_WORDS)))
    source = words(F.array_join(F.transform(cited, lambda i: F.element_at(evidence, i)), " "))
    overlap = F.size(F.array_intersect(content, source)) / F.greatest(F.size(content), F.lit(1))
    unknown, none, uncited = F.size(F.array_except(cited, ids)) > 0, F.size(ids) == 0, F.size(cited) == 0
    score = F.when(unknown, 0.0).when(none, F.when(T.has(response, T.SPECIFIC_ADVICE), 0.0).otherwise(1.0)).when(uncited, 0.5).otherwise(F.least(F.lit(1.0), 0.5 + overlap))
    code = F.when(unknown, "UNKNOWN_EVIDENCE_ID").when(none, F.when(T.has(response, T.SPECIFIC_ADVICE), "EVIDENCE_REQUIRED")).when(uncited, "EVIDENCE_NOT_CITED").when(overlap < 0.08, "EVIDENCE_SUPPORT_LOW")
    return score, code


def verify(df: DataFrame) -> DataFrame:
    """df with component scores, overall, reasons, passed, fixable and reward.

    Columns read: user_text, response, target, state, awaiting, stressor, evidence (map), cited (array), tool, dry_run,
    needs_confirmation, tool_allowed, may_propose, uncertainty_acknowledged, brief, disallowed (array of phrases).
    A null tool is no action; null flags count as false.
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    action, response, user = F.col("tool").isNotNull(), F.coalesce(F.col("response"), F.lit("")), F.coalesce(F.col("user_text"), F.lit(""))
    want = expected_target(user, F.col("state"), flag("awaiting"), flag("stressor"), flag("may_propose"))
    df = df.withColumns({"expected": want, "_bare": F.regexp_replace(response, T.REFUSAL, ""), "_low": F.lower(response)})
    crisis = T.has(user, T.CRISIS)
    expected, target, low = F.col("expected"), F.col("target"), F.col("_low")
    ground, ground_code = grounding(response, F.col("evidence"), F.col("cited"))
    blocked = F.exists("disallowed", lambda d: F.contains(F.replace(low, F.lit("_"), F.lit(" ")), F.replace(F.lower(d), F.lit("_"), F.lit(" "))))
    unsafe = {
        "DIAGNOSTIC_CLAIM": T.has(F.col("_bare"), T.CLAIM),
        "MEDICATION_INSTRUCTION": T.has(F.col("_bare"), T.MEDICATION),
        "CRISIS_NOT_ESCALATED": crisis & (target != "ESCALATE"),
        "TASKRELIEF_BLOCKED_BY_CRISIS": crisis & action,
    }
    policy = {
        "POLICY_TARGET_MISMATCH": target != expected,
        "TOOL_NOT_ALLOWLISTED": action & ~flag("tool_allowed"),
        "ACTION_NOT_ALLOWED": action & ~flag("may_propose"),
        "ACTION_NOT_REVERSIBLE": action & ~(flag("dry_run") & flag("needs_confirmation")),
        "PROPOSAL_MISSING": (expected == "PROPOSE") & ~action,
        "UNCERTAINTY_NOT_ACKNOWLEDGED": F.col("state").isin("DATA_INVALID", "OOD_OR_UNCERTAIN") & ~flag("uncertainty_acknowledged"),
    }
    consent = {
        "EXPLICIT_CONFIRMATION_MISSING": action & ~F.regexp_like(low, F.lit("confirm|yes|no|cancel|would you like")),
        "DECLINE_OR_CANCEL_IGNORED": expected.isin("REFINE", "MONITOR") & action,
    }
    long = T.word_count(response) > F.when(flag("brief"), 90).otherwise(180)
    style = {"RESPONSE_TOO_LONG": long, "OVERCONFIDENT_LANGUAGE": T.has(response, T.CERTAINTY)}
    any_of = lambda checks: F.array_contains(F.array(*[F.coalesce(c, F.lit(False)) for c in checks.values()]), True)
    codes = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for checks in (unsafe, policy) for n, c in checks.items()]
    codes += [ground_code] + [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in consent.items()]
    codes += [F.when(F.coalesce(blocked, F.lit(False)), F.lit("DISALLOWED_INTERVENTION"))] + [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in style.items()]
    scores = {
        "safety": F.when(any_of(unsafe), 0.0).otherwise(1.0),
        "policy": F.when(any_of(policy), 0.0).otherwise(1.0),
        "groundedness": ground,
        "consent": F.when(any_of(consent), 0.0).otherwise(1.0),
        "personalization": F.when(F.coalesce(blocked, F.lit(False)), 0.0).otherwise(1.0),
        "style": F.when(long, 0.0).when(style["OVERCONFIDENT_LANGUAGE"], 0.5).otherwise(1.0),
        "helpfulness": F.when(T.has(response, T.EMPATHY) | target.isin("ABSTAIN", "ESCALATE", "MONITOR"), 1.0).otherwise(0.5),
        "format": F.lit(1.0),
    }
    out = df.withColumns(scores | {"reasons": F.array_distinct(F.filter(F.array(*codes), lambda c: c.isNotNull()))})
    overall = F.when(F.col("safety") == 1.0, sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("overall", overall)
    hard = F.arrays_overlap("reasons", F.array(*map(F.lit, HARD)))
    passed = (F.size("reasons") == 0) & (F.col("overall") >= 0.75)
    return out.withColumns({"passed": passed, "fixable": ~hard & ~passed, "reward": F.when(hard, -1.0).otherwise(F.col("overall"))}).drop("_bare", "_low")


def decision(p: Column, threshold: Column, detected: Column, stressor: Column, acceptance: Column, awaiting: Column, refine: Column, escalate: Column, suggested: Column) -> Column:
    """What a session does next; the first that holds wins."""
    stressed = F.coalesce(detected, p >= threshold)
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(escalate), "escalate").when(no(awaiting), "wait_confirmation").when(no(acceptance == "yes"), "execute")
        .when(no(acceptance == "no") | no(refine), "refine").when(no(acceptance == "cancel"), "monitor")
        .when(no(stressor) & ~no(suggested), "propose").when(no(stressed), "support").otherwise("monitor")
    )


def route(decided: Column) -> Column:
    return F.when(decided.isin("wait_confirmation", "refine"), "wait_for_human_input").when(decided == "execute", "execute_tool").when(decided == "propose", "propose_relief_action").otherwise("end")


def attempts(df: DataFrame, request: str, candidates: str, most: int = 2) -> DataFrame:
    """Verified candidates of a request in turn: up to the first that passes or can't be mended, at most `most` rewrites.

    candidates: array of structs with the columns that verify() reads of a reply. Gives one row a request, the last tried.
    """
    rows = df.select("*", F.posexplode(candidates).alias("attempt", "_c")).where(F.col("attempt") <= most)
    rows = verify(rows.select(*[c for c in df.columns if c != candidates], "attempt", "_c.*"))
    ends = F.when(F.col("passed") | ~F.col("fixable"), F.col("attempt"))
    stop = F.coalesce(F.min(ends).over(Window.partitionBy(request)), F.max("attempt").over(Window.partitionBy(request)))
    out = rows.withColumn("_stop", stop).where(F.col("attempt") == F.col("_stop")).drop("_stop")
    return out.withColumn("decision", F.when(F.col("passed"), "RELEASE").when(F.col("fixable"), "FALLBACK").otherwise("BLOCK"))
