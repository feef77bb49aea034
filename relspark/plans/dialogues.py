"""Conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import text as T
from relspark.operators import audit, dialogue

LAST = """SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant, count(*) FILTER (WHERE role = 'user') AS user_turns,
  coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE role = 'user'), '') AS user_text FROM conversations GROUP BY 1"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.latest(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@register("latest_turn", LAST)
def latest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir)


@register("sft_rows", """SELECT conv_id, turn, target, context_turns FROM (SELECT conv_id, turn, role, text AS target, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_turns FROM conversations) WHERE role = 'assistant'""")
def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.training_rows(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@register("occurrence_ids", "SELECT conv_id, turn, CASE WHEN k > 1 THEN conv_id || ':' || role || '-' || k ELSE conv_id || ':' || role END AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)")
def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    base = F.concat_ws(":", "conv_id", "role")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", base.alias("b"), k.alias("k")).select("conv_id", "turn", F.when(F.col("k") > 1, F.concat("b", F.lit("-"), "k")).otherwise(F.col("b")).alias("id"))


ANSWERS = ["Yes.", " no thanks", "Cancel!", "change   it", "maybe", "OK"]
ANSWER = "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ANSWERS)) + " END"


@register("consent_route", f"""WITH t AS (SELECT DISTINCT conv_id FROM conversations), c AS (SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'cancel' WHEN 3 THEN 'refine' WHEN 5 THEN 'yes' END AS consent FROM t),
d AS (SELECT *, CASE WHEN consent = 'yes' THEN 'execute' WHEN consent IN ('no', 'refine') THEN 'refine' WHEN consent = 'cancel' THEN 'monitor' WHEN conv_id % 2 = 0 THEN 'propose' ELSE 'support' END AS decision FROM c)
SELECT conv_id, consent, decision, CASE decision WHEN 'refine' THEN 'wait_for_human_input' WHEN 'execute' THEN 'execute_tool' WHEN 'propose' THEN 'propose_relief_action' ELSE 'end' END AS edge FROM d""")
def consent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("consent", T.consent(F.expr(ANSWER)))
    none = F.lit(None).cast("boolean")
    d = dialogue.decision(F.lit(0.7), F.lit(0.5), none, F.col("conv_id") % 2 == 0, F.col("consent"), none, F.col("consent") == "refine", none, none)
    return df.withColumn("decision", d).withColumn("edge", dialogue.route(F.col("decision")))


CRISIS = T.CRISIS.replace("(?i)", "").replace("'", "''")


@register("crisis_flags", f"""SELECT conv_id, turn, regexp_matches(text || CASE WHEN (conv_id + turn) % 7 = 0 THEN ' I want to hurt myself' ELSE '' END, '{CRISIS}', 'i') AS crisis FROM conversations""")
def crisis_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, " I want to hurt myself").otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.has(said, T.CRISIS).alias("crisis"))


@register("verifier_scores", f"""WITH l AS ({LAST}), v AS (SELECT conv_id, len(list_filter(regexp_split_to_array(coalesce(last_assistant, ''), '\\s+'), lambda w: w <> '')) AS n,
  CASE conv_id % 4 WHEN 0 THEN 'RELIABLE_LOW' WHEN 1 THEN 'MONITOR' WHEN 2 THEN 'RELIABLE_ELEVATED' ELSE 'DATA_INVALID' END AS state FROM l),
s AS (SELECT conv_id, CASE WHEN state IN ('RELIABLE_LOW', 'RELIABLE_ELEVATED') THEN 1.0 ELSE 0.0 END AS policy, CASE WHEN n > 90 THEN 0.0 ELSE 1.0 END AS style FROM v)
SELECT conv_id, policy, style, round(0.25 + 0.2 * policy + 0.15 + 0.1 + 0.075 + 0.05 * style + 0.1, 6) AS overall, policy = 1.0 AND style = 1.0 AS passed FROM s""")
def verifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies taken as support, without evidence or action, under a state by conversation."""
    state = F.element_at(F.array(*map(F.lit, ("RELIABLE_LOW", "MONITOR", "RELIABLE_ELEVATED", "DATA_INVALID"))), (F.col("conv_id") % 4 + 1).cast("int"))
    no, none = F.lit(False), F.lit(None).cast("string")
    df = turns(spark, sf_dir).select(
        "conv_id", F.col("last_user").alias("user_text"), F.col("last_assistant").alias("response"), F.lit("SUPPORT").alias("target"), state.alias("state"), no.alias("awaiting"), no.alias("stressor"),
        F.create_map().cast("map<string,string>").alias("evidence"), F.array().cast("array<string>").alias("cited"), none.alias("tool"), no.alias("dry_run"), no.alias("needs_confirmation"), no.alias("tool_allowed"),
        no.alias("may_propose"), F.lit(True).alias("uncertainty_acknowledged"), F.lit(True).alias("brief"), F.array().cast("array<string>").alias("disallowed"),
    )
    return dialogue.verify(df).select("conv_id", "policy", "style", F.round("overall", 6).alias("overall"), "passed")


@register("dataset_validation", """WITH c AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM conversations)
SELECT concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'EMPTY' END, CASE WHEN n > 1 THEN 'TURN_REPEATED' END, CASE WHEN length(text) < 40 THEN 'SHORT' END) AS issues, role, count(*) AS n FROM c GROUP BY 1, 2""")
def dataset_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    df = read(spark, sf_dir, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id", "turn")))
    codes = audit.issues({"EMPTY": F.coalesce(F.trim("text") == "", F.lit(True)), "TURN_REPEATED": F.col("n") > 1, "SHORT": F.length("text") < 40})
    return df.groupBy(F.array_join(codes, ",").alias("issues"), "role").agg(F.count("*").alias("n"))


@register("label_completion_eval", """SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS parse_rate, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS violation_rate,
  round(avg(quality - toxic), 6) AS mean_reward, round(avg(n_chars), 4) AS mean_words, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) >= 0.99 AND sum(toxic) = 0 AS gate FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def label_completion_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    out = audit.completion_eval(df, q, q & ~t, t, F.col("quality") - F.col("toxic"), F.col("n_chars"), ["lang"])
    return out.withColumns({c: F.round(c, 6) for c in ("parse_rate", "accuracy", "violation_rate", "mean_reward")} | {"mean_words": F.round("mean_words", 4)})
