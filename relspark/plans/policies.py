"""Decision metrics, audits, evidence and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import text as T
from relspark.operators import cascade, fit, policy, prepare, ranks
from relspark.plans.measures import r6
from relspark.plans.sessions import CASCADE_STEPS, POLICY, inferences

DECIDED = CASCADE_STEPS + """, d2 AS (
SELECT seq, gate AS state FROM h WHERE gate IS NOT NULL UNION ALL SELECT seq, CASE WHEN active THEN 'RELIABLE_ELEVATED' WHEN c > 0.45 THEN 'MONITOR' ELSE 'RELIABLE_LOW' END FROM live),
r AS (SELECT h.*, d2.state, session % 5 AS fold, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS y, coalesce(gate, '') <> 'DATA_INVALID' AS valid, CASE WHEN coalesce(gate, '') <> 'DATA_INVALID' AND h.d <= 4 THEN CAST(c <= 0.4 AS INT) + CAST(1 - c <= 0.4 AS INT) END AS n_set FROM h JOIN d2 USING (seq))"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows with their decisions, a fold and a label."""
    rows = inferences(spark, sf_dir).withColumns({"fold": F.col("session") % 5, "y": (F.col("external_quality") >= 0.5).cast("int")})
    return cascade.decide(rows, POLICY)


@register("policy_metrics", DECIDED + """ SELECT fold, count(*) AS n, count(*) FILTER (WHERE state = 'DATA_INVALID') AS data_invalid, count(*) FILTER (WHERE state = 'OOD_OR_UNCERTAIN') AS ood_or_uncertain, count(*) FILTER (WHERE state = 'RELIABLE_LOW') AS reliable_low,
  count(*) FILTER (WHERE state = 'MONITOR') AS monitor, count(*) FILTER (WHERE state = 'RELIABLE_ELEVATED') AS reliable_elevated, count(*) FILTER (WHERE state LIKE 'RELIABLE%') AS accepted, count(*) FILTER (WHERE state LIKE 'RELIABLE%' AND (state = 'RELIABLE_ELEVATED') <> (y = 1)) AS wrong, count(n_set) AS sets,
  round(count(*) FILTER (WHERE state LIKE 'RELIABLE%') / count(*), 6) AS coverage, round(coalesce(count(*) FILTER (WHERE state LIKE 'RELIABLE%' AND (state = 'RELIABLE_ELEVATED') <> (y = 1)) / nullif(count(*) FILTER (WHERE state LIKE 'RELIABLE%'), 0), 0), 6) AS risk,
  round(coalesce(count(*) FILTER (WHERE n_set IS NOT NULL AND CASE WHEN y = 1 THEN 1 - c <= 0.4 ELSE c <= 0.4 END) / nullif(count(n_set), 0), 0), 6) AS set_coverage, round(coalesce(count(*) FILTER (WHERE n_set = 1) / nullif(count(n_set), 0), 0), 6) AS singleton_rate FROM r GROUP BY fold""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(policy.policy_metrics(decided(spark, sf_dir), "y", ["fold"]), "coverage", "risk", "set_coverage", "singleton_rate")


@register("policy_methods", DECIDED + """, m AS (SELECT fold, y, unnest([{'method': 'raw_0.5', 'hit': coalesce(pr >= 0.5, false), 'ok': true}, {'method': 'calibrated', 'hit': valid AND coalesce(c >= 0.5, false), 'ok': true}, {'method': 'quality_ood', 'hit': valid AND coalesce(c >= 0.5, false), 'ok': valid AND d <= 4},
  {'method': 'selective', 'hit': valid AND coalesce(c >= 0.5, false), 'ok': gate IS NULL}, {'method': 'full_temporal', 'hit': state = 'RELIABLE_ELEVATED', 'ok': state LIKE 'RELIABLE%'}], recursive := true) FROM r)
SELECT fold, method, count(*) AS n, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE ok AND hit AND y = 1) AS tp, count(*) FILTER (WHERE ok AND hit AND y = 0) AS fp, count(*) FILTER (WHERE ok AND hit <> (y = 1)) AS wrong,
  round(count(*) FILTER (WHERE ok) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE ok AND hit <> (y = 1)) / nullif(count(*) FILTER (WHERE ok), 0), 6) AS risk FROM m GROUP BY ALL""")
def policy_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decided(spark, sf_dir)
    valid = F.col("calibrated_probability").isNotNull()
    df = df.withColumns({"ood_ok": valid & (F.col("ood_score") <= POLICY.ood_threshold), "selective_ok": ~F.col("state").isin("DATA_INVALID", "OOD_OR_UNCERTAIN")})
    return r6(policy.policy_methods(df, "y", ["fold"]), "coverage", "risk")


@register("state_reasons", """WITH q AS (SELECT CASE WHEN event_id % 53 = 0 THEN 'MODEL_ID_MISMATCH' WHEN event_id % 41 = 0 THEN 'FEATURE_COUNT_INVALID' WHEN event_id % 43 = 0 THEN 'NONFINITE_FEATURE'
  WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 < 0.02 THEN 'EXTERNAL_QUALITY_LOW' WHEN greatest(abs(value - 20.0) / 20.0, abs(CAST(json_extract(props, '$.k') AS DOUBLE) - 50.0) / 30.0) >= 15 THEN 'FEATURE_OUT_OF_RANGE'
  WHEN event_id % 47 = 0 THEN 'PROBABILITY_INVALID' END AS reason FROM events) SELECT 'DATA_INVALID' AS state, reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason""")
def state_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of invalid rows, counted."""
    rows = decided(spark, sf_dir).where("state = 'DATA_INVALID'").select("state", F.explode("reasons").alias("reason"))
    return rows.groupBy("state", "reason").agg(F.count("*").alias("n"))


@register("corruption_audit", """WITH i AS (SELECT event_id AS e, value AS f1, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, value / (value + 20.0) AS pr FROM events WHERE event_id % 41 <> 0 AND event_id % 43 <> 0 AND event_id % 47 <> 0 AND event_id % 53 <> 0),
x AS (SELECT *, greatest(abs(f1 * 50 - 20.0) / 20.0, abs(k * 50 - 50.0) / 30.0) AS z, sqrt((pow((f1 * 50 - 20.0) / 20.0, 2) + pow((k * 50 - 50.0) / 30.0, 2)) / 2) AS d FROM i),
o AS (SELECT *, k / 100 < 0.02 OR z >= 15 OR d > 4 OR greatest(pr, 1 - pr) < 0.6 AS bad FROM x)
SELECT c AS corruption, count(*) AS n, count(*) FILTER (WHERE c <> 'extreme' OR bad) AS rejected, round(count(*) FILTER (WHERE c <> 'extreme' OR bad) / count(*), 6) AS rate FROM o CROSS JOIN (SELECT unnest(['nonfinite', 'extreme', 'feature_order']) AS c) GROUP BY 1""")
def corruption_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inferences(spark, sf_dir).where("seq % 41 <> 0 AND seq % 43 <> 0 AND seq % 47 <> 0 AND seq % 53 <> 0")
    return r6(policy.corruptions(rows, POLICY), "rate")


ANSWERS = "SELECT conv_id, turn, ['base', 'sft', 'grpo'][1 + conv_id % 3] AS model, length(text) % 101 / 100.0::DOUBLE AS reward, len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS words, strpos(text, 'q') = 0 AS safe FROM conversations WHERE role = 'assistant' AND trim(text) <> ''"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").where("role = 'assistant' AND trim(text) <> ''")
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    model = F.element_at(F.array(F.lit("base"), F.lit("sft"), F.lit("grpo")), (F.col("conv_id") % 3 + 1).cast("int"))
    return df.select("conv_id", "turn", model.alias("model"), (F.char_length("text") % 101 / 100.0).alias("reward"), words.alias("words"), (F.instr("text", "q") == 0).alias("safe"))


@register("reward_audit", f"""WITH a AS ({ANSWERS}), g AS (SELECT model, count(*) AS n, avg(reward) AS mean_reward, corr(words, reward) AS r, count(*) FILTER (WHERE reward >= 0.75 AND NOT safe) AS u FROM a GROUP BY 1)
SELECT model, n, round(mean_reward, 6) AS mean_reward, round(r, 6) AS correlation, u AS unsafe_high, u = 0 AND abs(r) < 0.5 AS passed FROM g""")
def reward_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(policy.reward_audit(answers(spark, sf_dir), "reward", "words", "safe", ["model"]), "mean_reward", "correlation")


@register("report_comparison", f"""WITH a AS ({ANSWERS}), g AS (SELECT model, avg(reward) AS m, avg(CAST(words % 2 = 0 AS INT)) AS cit, avg(CAST(words % 3 = 0 AS INT)) AS p, avg(CAST(NOT safe AS INT)) AS v, bool_and(safe) AS gate FROM a GROUP BY 1),
x AS (SELECT g.m - s.m AS d, g.cit - s.cit AS c, g.p - s.p AS p, g.v - s.v <= 0 AS ok, g.gate FROM g JOIN g s ON g.model = 'grpo' AND s.model = 'sft')
SELECT round(d, 6) AS reward_delta, round(c, 6) AS citation_delta, round(p, 6) AS policy_delta, ok AS safety_not_worse, gate, ok AND d > 0 AND gate AS deploy FROM x""")
def report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.expr(c).cast("int"))
    reports = answers(spark, sf_dir).groupBy("model").agg(F.avg("reward").alias("mean_reward"), share("words % 2 = 0").alias("citation_accuracy"), share("words % 3 = 0").alias("policy_accuracy"), share("NOT safe").alias("violation_rate"), F.bool_and("safe").alias("gate"))
    return r6(policy.compare_reports(reports), "reward_delta", "citation_delta", "policy_delta")


LICENCE = "CASE WHEN e % 7 = 0 THEN ' Unknown' WHEN e % 5 = 0 THEN NULL ELSE 'CC-BY-4.0' END"


@register("evidence_filter", f"""WITH v AS (SELECT event_id, user_id, value / 100.0 AS score, event_id AS e, {LICENCE.replace(' e ', ' event_id ')} AS licence FROM events),
f AS (SELECT user_id % 500 AS u, event_id % 20 AS h, score >= 0.35 AND lower(trim(coalesce(licence, ''))) NOT IN ('', 'unknown') AS kept, lower(trim(coalesce(licence, ''))) IN ('', 'unknown') AS bad FROM v)
SELECT u, h, count(*) FILTER (WHERE kept) AS kept, CASE WHEN count(*) FILTER (WHERE kept) = 0 AND bool_or(bad) THEN 'EVIDENCE_LICENSE_UNRESOLVED' WHEN count(*) FILTER (WHERE kept) = 0 THEN 'EVIDENCE_INSUFFICIENT' WHEN count(*) FILTER (WHERE kept) < count(*) THEN 'EVIDENCE_FILTERED' END AS reason FROM f GROUP BY 1, 2""")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct((F.col("value") / 100).alias("score"), F.expr(LICENCE.replace(" e ", " event_id ")).alias("license"))
    rows = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 500).alias("u"), (F.col("event_id") % 20).alias("h")).agg(F.collect_list(one).alias("evidence"))
    kept, reason = policy.evidence_filter(F.col("evidence"), 0.35)
    return rows.select("u", "h", F.size(kept).cast("long").alias("kept"), reason.alias("reason"))


MARKED = "CASE WHEN doc_id % 9 = 0 THEN 'I want to  END my' || chr(10) || 'life ' || coalesce(text, '') WHEN doc_id % 11 = 0 THEN coalesce(text, '') || ' self  Harm' WHEN doc_id % 13 = 0 THEN 'hurt someone ' || coalesce(text, '') ELSE text END"


@register("runtime_crisis", f"SELECT doc_id, regexp_matches(regexp_replace(lower(coalesce({MARKED}, '')), '\\s+', ' ', 'g'), '\\bsuicid(e|al)\\b|\\bkill myself\\b|\\bend my life\\b|\\bhurt myself\\b|\\bself[ -]?harm\\b') AS crisis FROM documents")
def runtime_crisis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED.replace("chr(10)", r"'\n'")).alias("t"))
    return df.select("doc_id", policy.runtime_crisis(F.col("t")).alias("crisis"))


@register("label_subset", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def label_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@register("task_files", "SELECT d.lang, count(*) AS tasks, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(l.doc_id) AS found FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks beside their files: what is missing is counted and nothing fails."""
    files = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("there"))
    out = read(spark, sf_dir, "documents").select("doc_id", "lang").join(files, "doc_id", "left").groupBy("lang")
    return out.agg(F.count("*").alias("tasks"), F.count_if(F.col("there").isNull()).alias("missing"), F.count("there").alias("found"))


@register("robust_clip", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(least(greatest((l_extendedprice - q[2]) / greatest(q[3] - q[1], 1e-6), -1.2), 1.2), 6) AS z FROM lineitem JOIN q USING (l_returnflag)""")
def robust_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = prepare.robust_scaled(rows, ["l_returnflag"], ["l_extendedprice"], 1.2)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_z", 6).alias("z"))


SUBJECTS = "SELECT c_custkey AS subject, coalesce(avg(CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT)), 0) AS ratio FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"


@register("stratified_subjects", f"""WITH s AS ({SUBJECTS}), n AS (SELECT least(count(*) - 1, greatest(1, CAST(round_even(count(*) * 0.17, 0) AS BIGINT))) AS target FROM s),
b AS (SELECT *, CAST(ntile(7) OVER (ORDER BY ratio, subject) AS INT) AS bin FROM s), z AS (SELECT bin, count(*) AS size FROM b GROUP BY 1),
u AS (SELECT bin, row_number() OVER (ORDER BY unit, size DESC, bin) AS i FROM (SELECT bin, size, unnest(range(size)) AS unit FROM z)), t AS (SELECT bin, count(*) AS take FROM u, n WHERE i <= target GROUP BY 1)
SELECT subject, round(ratio, 6) AS ratio, bin, row_number() OVER (PARTITION BY bin ORDER BY sha256('42:' || subject), subject) <= take AS chosen FROM b JOIN t USING (bin)""")
def stratified_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth of the customers, spread evenly over seven bins of their share of urgent orders."""
    urgent = F.avg(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"))
    ratios = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject")).agg(urgent.alias("r"))
    subjects = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject")).join(ratios, "subject", "left").select("subject", F.coalesce("r", F.lit(0.0)).alias("ratio"))
    return r6(prepare.choose_subjects(subjects, "subject", "ratio", 0.17, 7), "ratio")


BROKEN = "CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE 0.4 + least(value, 160) / 200 END"


@register("robust_baseline", f"""WITH b AS (SELECT user_id, event_id // 1250 AS w, {BROKEN} AS x FROM events),
f AS (SELECT user_id, w, unnest(['rr_mean', 'rms']) AS feature, unnest([avg(x), sqrt(avg(x * x))]) AS value FROM b GROUP BY user_id, w),
g AS (SELECT user_id, unnest(['rr_mean', 'rms']) AS feature, unnest([avg(x), sqrt(avg(x * x))]) AS value FROM b GROUP BY user_id),
m AS (SELECT user_id, feature, median(value) AS value FROM f WHERE isfinite(value) GROUP BY ALL)
SELECT g.user_id, g.feature, round(CASE WHEN isfinite(g.value) THEN g.value ELSE m.value END, 6) AS value, CASE WHEN isfinite(g.value) THEN 'whole' WHEN m.value IS NULL THEN 'none' ELSE 'windows' END AS origin FROM g LEFT JOIN m USING (user_id, feature)""")
def robust_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' beat intervals, of which errors break the whole recording and their own windows."""
    rows = read(spark, sf_dir, "events").select("user_id", F.floor(F.col("event_id") / 1250).alias("w"), F.expr(BROKEN).alias("x"))
    features = lambda *by: ranks.melted(rows.groupBy(*by).agg(F.avg("x").alias("a"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("r")), list(by), {"rr_mean": F.col("a"), "rms": F.col("r")})
    return r6(prepare.robust_baseline(features("user_id"), features("user_id", "w"), ["user_id"], "column", "value"), "value").withColumnRenamed("column", "feature")


@register("temperature_steps", """WITH e AS (SELECT 3 * ln((value + 1) / 18) AS l, CASE WHEN value + event_id % 7 * 8 > 42 THEN 1 ELSE 0 END AS y FROM events),
t AS (SELECT 0.5 + 0.005 * i AS t FROM range(1500) AS r(i)), f AS (SELECT t, avg(greatest(l / t, 0) - l / t * y + ln(1 + exp(-abs(l / t)))) AS loss FROM e, t GROUP BY 1) SELECT round(min(loss), 5) AS loss FROM f""")
def temperature_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least loss that a temperature reaches; the SQL tries a grid."""
    rows = read(spark, sf_dir, "events").select((3 * F.log((F.col("value") + 1) / 18)).alias("l"), (F.col("value") + F.col("event_id") % 7 * 8 > 42).cast("int").alias("y"))
    _, loss = fit.temperature_steps(rows, "y", "l")
    return spark.range(1).select(F.round(F.lit(loss), 5).alias("loss"))


@register("merged_groups", """WITH RECURSIVE m AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey * 10 + c_custkey % 10 END AS g FROM customer),
e AS (SELECT k AS a, min(k) OVER (PARTITION BY g) AS b FROM m WHERE g IS NOT NULL UNION SELECT k, k + 1 FROM m WHERE k % 50 = 0 AND k + 1 IN (SELECT k FROM m)), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT k AS node, k AS root FROM m UNION SELECT b.b, w.root FROM w JOIN b ON b.a = w.node) SELECT node AS c_custkey, min(root) AS cluster FROM w GROUP BY 1""")
def merged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_nationkey * 10 + c_custkey % 10 END")
    members = read(spark, sf_dir, "customer").select("c_custkey", group.alias("g"))
    keys = members.select("c_custkey")
    near = keys.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")).join(keys.withColumnRenamed("c_custkey", "b"), "b", "left_semi")
    return policy.merged_groups(members, "c_custkey", "g", near)


@register("position_split", "SELECT item_id, CASE WHEN i < 8 THEN 'train' WHEN i < 10 THEN 'validation' ELSE 'test' END AS split FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark)")
def position_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight train, the next two validate, the rest test: only ten rows are ordered, so no window spans the table."""
    df = read(spark, sf_dir, "benchmark").select("item_id")
    first = [r.item_id for r in df.orderBy("item_id").limit(10).collect()]
    return df.withColumn("split", F.when(F.col("item_id").isin(first[:8]), "train").when(F.col("item_id").isin(first[8:]), "validation").otherwise("test"))


@register("smoothed", "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5.0, 6) AS smooth FROM events")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-point moving average; beyond the ends stand zeros."""
    return read(spark, sf_dir, "events").select("event_id", F.round(prepare.moving_average("value", ["user_id"], "event_id", 2), 6).alias("smooth"))


@register("completion_pairs", "SELECT u.conv_id AS place, length(u.text) AS asked, length(a.text) AS answered FROM (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY 1) u JOIN (SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY 1) a USING (conv_id)")
def completion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("place"))
    pairs = policy.paired(df.agg(F.min_by("text", "turn").alias("q")), df.agg(F.max_by("text", "turn").alias("a")), "place")
    return pairs.select("place", F.char_length("q").cast("long").alias("asked"), F.char_length("a").cast("long").alias("answered"))


@register("error_rows_skipped", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 AND length(text) < 60 THEN NULL ELSE length(text) END AS score FROM conversations")
def error_rows_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an error and no answer stay without a score."""
    failed = (F.col("turn") % 4 == 3) & (F.char_length("text") < 60)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~failed, F.char_length("text")).cast("long").alias("score"))


@register("questionnaire_totals", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def questionnaire_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.expr("aggregate(embedding, 0.0D, (a, x) -> a + x)"), 4).alias("total"))


@register("casefolded_tokens", "SELECT doc_id, len(regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '[\\p{L}\\p{N}_'']+')) AS tokens FROM documents")
def casefolded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(T.casefold(T.normal_form(F.coalesce("text", F.lit("")))), F.lit(T.TOKEN), 1)).cast("long").alias("tokens"))
