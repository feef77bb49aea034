"""The assistant's turns over conversations: users' texts, some of them answers, and replies as JSON, some of them wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from relspark.catalog import read, register
from relspark.functions import canonical
from relspark.operators import assistant

SAID = "CASE WHEN role = 'user' THEN CASE (conv_id * 5 + turn * 3) % 11 WHEN 0 THEN 'Yes.' WHEN 1 THEN ' nah ' WHEN 2 THEN 'Never  mind!' WHEN 3 THEN 'ok' WHEN 4 THEN '  hm ' WHEN 5 THEN CASE WHEN conv_id % 4 = 0 THEN 'I want to hurt  myself' ELSE text END ELSE text END END"
STRESSED = "(conv_id * 7 + turn) % 10 < 6"
BRANCHES = f"""u AS (SELECT conv_id, turn, {SAID} AS said, {STRESSED} AS stressed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
k AS (SELECT *, lower(regexp_replace(trim(regexp_replace(said, '\\s+', ' ', 'g')), '[.!?]+$', '')) AS a, length(regexp_replace(said, '^\\s+|\\s+$', '', 'g')) AS n FROM u),
m AS (SELECT *, CASE WHEN said IS NULL THEN NULL WHEN regexp_matches(regexp_replace(lower(said), '\\s+', ' ', 'g'), '\\bsuicid(e|al)\\b|\\bkill myself\\b|\\bend my life\\b|\\bhurt myself\\b|\\bself[ -]?harm\\b') THEN 'crisis' WHEN a IN ('yes', 'y', 'sure', 'ok', 'okay', 'proceed', 'confirm') THEN 'yes'
  WHEN a IN ('no', 'n', 'nope', 'nah', 'no thanks', 'do not proceed') THEN 'no' WHEN a IN ('cancel', 'stop', 'never mind', 'nevermind') THEN 'cancel' WHEN n < 6 THEN 'short' ELSE 'text' END AS kind FROM k),
r AS (SELECT conv_id, 0::BIGINT AS i, false AS awaiting, false AS refining, false AS cancelled, false AS escalated, false AS concern, NULL::VARCHAR AS branch FROM m GROUP BY 1
  UNION ALL SELECT m.conv_id, m.i, CASE WHEN kind IS NULL THEN awaiting WHEN kind = 'crisis' THEN false WHEN awaiting THEN kind NOT IN ('yes', 'no', 'cancel') WHEN refining THEN kind IN ('text', 'short') WHEN cancelled OR concern THEN false ELSE kind = 'text' AND stressed AND NOT escalated END,
  CASE WHEN kind IS NULL THEN refining WHEN kind = 'crisis' THEN false WHEN awaiting THEN kind = 'no' ELSE refining AND kind IN ('yes', 'no', 'cancel') END,
  CASE WHEN kind IS NULL THEN cancelled WHEN kind = 'crisis' THEN false ELSE cancelled OR awaiting AND kind = 'cancel' END, escalated OR coalesce(kind = 'crisis', false),
  CASE WHEN kind IS NULL THEN concern WHEN kind = 'crisis' THEN false WHEN awaiting THEN kind <> 'yes' WHEN concern THEN true ELSE kind = 'text' AND stressed END,
  CASE WHEN kind IS NULL THEN NULL WHEN kind = 'crisis' THEN 'crisis' WHEN awaiting AND kind = 'yes' THEN CASE WHEN stressed THEN 'confirm>execute>explore' ELSE 'confirm>execute>none' END WHEN awaiting AND kind IN ('no', 'cancel') THEN 'confirm' WHEN awaiting THEN 'ask_again'
    WHEN refining THEN CASE WHEN kind IN ('text', 'short') THEN 'refine>propose>present' ELSE 'none' END WHEN concern THEN 'none' WHEN kind = 'text' AND stressed THEN CASE WHEN escalated THEN 'concern' ELSE 'concern>propose>present' END WHEN kind = 'text' THEN 'reply' WHEN stressed THEN 'explore' ELSE 'none' END
  FROM r JOIN m ON m.conv_id = r.conv_id AND m.i = r.i + 1),
b AS (SELECT m.conv_id, m.turn, m.kind, m.said, r.branch, CASE WHEN r.awaiting THEN 'AWAITING' WHEN r.refining THEN 'REFINING' WHEN r.cancelled THEN 'CANCELLED' WHEN r.escalated THEN CASE WHEN r.concern THEN 'ESCALATED_KNOWN' ELSE 'ESCALATED' END ELSE 'IDLE' END AS next_state FROM r JOIN m USING (conv_id, i))"""


def branched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("said", F.expr(SAID))
    return assistant.branches(rows, "conv_id", "turn", F.col("said"), F.expr(STRESSED))


@register("dialogue_branches", f"WITH RECURSIVE {BRANCHES} SELECT conv_id, turn, kind, branch, next_state FROM b")
def dialogue_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branched(spark, sf_dir).select("conv_id", "turn", "kind", "branch", "next_state")


INPUT = StructType([StructField("plan", StringType()), StructField("turn", LongType()), StructField("sources", MapType(StringType(), StringType()))])


@register("dry_runs", f"""WITH RECURSIVE {BRANCHES}, t AS (SELECT conv_id, turn, CASE WHEN kind = 'short' THEN NULL WHEN conv_id % 5 = 0 THEN 'send_mail' ELSE 'dry_run_schedule_adjustment' END AS tool, CASE WHEN turn % 5 = 4 THEN 'live' ELSE 'dry_run' END AS mode, kind FROM b WHERE kind IS NOT NULL),
o AS (SELECT *, CASE WHEN tool IS NULL THEN 'none' WHEN kind <> 'yes' THEN 'skipped' WHEN mode <> 'dry_run' OR tool = 'send_mail' THEN 'blocked' ELSE 'simulated' END AS outcome FROM t)
SELECT conv_id, turn, outcome, CASE WHEN outcome = 'simulated' THEN '[DRY-RUN] {{"execution_mode": "dry_run", "external_side_effects": false, "status": "simulated", "tool_name": "' || tool || '", "would_apply": {{"plan": "rest \\"10\\" min", "sources": {{"a": "é", "b": "x"}}, "turn": ' || turn || '}}}}' END AS output FROM o""")
def dry_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = branched(spark, sf_dir).where(F.col("kind").isNotNull())
    tool = F.when(F.col("kind") != "short", F.when(F.col("conv_id") % 5 == 0, "send_mail").otherwise(assistant.TOOL))
    given = F.struct(F.lit('rest "10" min').alias("plan"), F.col("turn").cast("long").alias("turn"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.lit("é")).alias("sources"))
    outcome, output = assistant.dry_run(F.col("kind"), tool, F.when(F.col("turn") % 5 == 4, "live").otherwise("dry_run"), given, INPUT)
    return df.select("conv_id", "turn", outcome.alias("outcome"), output.alias("output"))


REPLY = """CASE (conv_id * 3 + turn) % 13 WHEN 0 THEN '{"response": "a", "policy_target": "support", "evidence_ids": ["e1", "e2"]}' WHEN 1 THEN '{"response": "a", "policy_target": "support", "mood": 1}' WHEN 2 THEN '{"response": "a"}' WHEN 3 THEN '{"response": 5, "policy_target": "support"}'
 WHEN 4 THEN '{"response": "a", "policy_target": "support"' WHEN 5 THEN '["response", "policy_target"]' WHEN 6 THEN '{"response": " ", "policy_target": "ask"}' WHEN 7 THEN '{"response": "a", "policy_target": "sing"}' WHEN 8 THEN '{"response": "a", "policy_target": "propose", "proposed_action": {"tool_name": "t", "execution_mode": "live"}}'
 WHEN 9 THEN '{"response": "a", "policy_target": "propose", "proposed_action": {"tool_name": "t", "requires_confirmation": true}, "uncertainty_acknowledged": true}' WHEN 10 THEN '{"response": "a", "policy_target": "ask", "evidence_ids": "e1", "proposed_action": null}' WHEN 11 THEN text ELSE '{"response": "a", "policy_target": "monitor", "proposed_action": null, "evidence_ids": []}' END"""
KNOWN = "['response', 'policy_target', 'evidence_ids', 'proposed_action', 'uncertainty_acknowledged']"


@register("candidate_codes", f"""WITH r AS (SELECT conv_id, turn, {REPLY} AS j FROM conversations WHERE role = 'assistant'), v AS (SELECT *, json_valid(j) AS good, CASE WHEN json_valid(j) THEN j END AS x FROM r),
c AS (SELECT *, CASE WHEN x IS NULL THEN 'NOT_JSON' WHEN json_type(x) <> 'OBJECT' THEN 'NOT_OBJECT' WHEN len(list_filter(json_keys(x), lambda k: NOT list_contains({KNOWN}, k))) > 0 THEN 'UNKNOWN_FIELD' WHEN NOT list_has_all(json_keys(x), ['response', 'policy_target']) THEN 'MISSING_FIELD'
  WHEN json_type(x, '$.response') <> 'VARCHAR' OR json_type(x, '$.policy_target') <> 'VARCHAR' OR coalesce(json_type(x, '$.evidence_ids'), 'ARRAY') <> 'ARRAY' OR coalesce(json_type(x, '$.proposed_action'), 'NULL') NOT IN ('OBJECT', 'NULL') OR coalesce(json_type(x, '$.uncertainty_acknowledged'), 'BOOLEAN') <> 'BOOLEAN' THEN 'WRONG_TYPE'
  WHEN trim(x ->> '$.response') = '' THEN 'RESPONSE_EMPTY' WHEN (x ->> '$.policy_target') NOT IN ('support', 'ask', 'abstain', 'escalate', 'propose', 'confirm', 'refine', 'monitor') THEN 'TARGET_UNKNOWN'
  WHEN json_type(x, '$.proposed_action') = 'OBJECT' AND (coalesce(x ->> '$.proposed_action.tool_name', '') = '' OR coalesce(x ->> '$.proposed_action.execution_mode', 'dry_run') <> 'dry_run' OR (x ->> '$.proposed_action.requires_confirmation') = 'false') THEN 'ACTION_INVALID' END AS code FROM v)
SELECT conv_id, turn, code, CASE WHEN code IS NULL THEN upper(x ->> '$.policy_target') END AS target, CASE WHEN code IS NULL THEN coalesce(json_array_length(x, '$.evidence_ids'), 0)::BIGINT END AS cited, CASE WHEN code IS NULL THEN x ->> '$.proposed_action.tool_name' END AS tool FROM c""")
def candidate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    parsed, code = canonical.candidate(F.expr(REPLY))
    df = df.select("conv_id", "turn", parsed.alias("c"), code.alias("code"))
    return df.select("conv_id", "turn", "code", F.col("c.policy_target").alias("target"), F.when(F.col("c").isNotNull(), F.size("c.evidence_ids")).cast("long").alias("cited"), F.col("c.tool_name").alias("tool"))


@register("canonical_json", """SELECT doc_id, sha256('{"a": {"doc_id": ' || doc_id || ', "source": ' || coalesce(to_json(source)::VARCHAR, 'null') || '}, "lang": ' || coalesce(to_json(lang)::VARCHAR, 'null') || ', "sizes": [' || coalesce(n_chars::VARCHAR, 'null') || ', ' || length(text) || '], "text": ' || to_json(text)::VARCHAR || '}') AS digest FROM documents""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as one JSON text each, by its digest."""
    df = read(spark, sf_dir, "documents").select("doc_id", F.struct("text", "lang", F.array("n_chars", F.char_length("text").cast("long")).alias("sizes"), F.struct("source", "doc_id").alias("a")).alias("row"))
    return df.select("doc_id", F.sha2(canonical.json_text(F.col("row"), df.schema["row"].dataType), 256).alias("digest"))
