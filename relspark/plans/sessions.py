"""Sessions of scored events: probability value / (value + 20), session user_id, order event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.operators import cascade, temporal

SCORED = "SELECT event_id AS seq, user_id AS session, ts, value / (value + 20.0) AS p, event_type FROM events"
ELEVATED = f"""scored AS ({SCORED}), counted AS (
  SELECT *, sum(CASE WHEN p >= 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM scored),
flagged AS (SELECT *, CASE WHEN p >= 0.65 AND n >= 2 THEN 1 WHEN p <= 0.45 THEN 0 END AS event FROM counted),
live AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS active FROM flagged),
states AS (SELECT *, CASE WHEN active THEN 'ELEVATED' WHEN p > 0.45 THEN 'MONITOR' ELSE 'LOW' END AS state FROM live)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("value") / (F.col("value") + 20)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), p.alias("p"), "event_type")


@register("k_of_m", f"WITH {ELEVATED} SELECT seq, CAST(n AS BIGINT) AS elevated FROM states")
def k_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("seq", temporal.k_of_m(F.col("p"), "session", "seq", 0.65, 3).alias("elevated"))


@register("temporal_states", f"WITH {ELEVATED} SELECT seq, session, active, state FROM states")
def temporal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.states(scored(spark, sf_dir)).select("seq", "session", "active", "state")


@register(
    "cooldown_notifications",
    f"""WITH RECURSIVE {ELEVATED}, act AS (SELECT session, seq, ts FROM states WHERE active),
sent AS (SELECT session, min(ts) AS ts FROM act GROUP BY session
  UNION ALL SELECT s.session, (SELECT min(a.ts) FROM act a WHERE a.session = s.session AND a.ts >= s.ts + INTERVAL 48 HOUR) FROM sent s WHERE s.ts IS NOT NULL)
SELECT a.seq, a.session FROM sent s JOIN act a ON a.session = s.session AND a.ts = s.ts""",
)
def cooldown_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = temporal.states(scored(spark, sf_dir))
    return temporal.notifications(live, "session", "seq", "ts", "active", 48 * 3600).select("seq", "session")


LATE = "event_id + CASE WHEN event_id % 10 = 0 THEN 500 ELSE 0 END"


@register(
    "order_violations",
    f"""SELECT event_id, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY {LATE}, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM events""",
)
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("arrival", F.struct(F.expr(LATE), "event_id"))
    return df.select("event_id", temporal.out_of_order("user_id", "arrival", "ts").alias("late"))


@register(
    "bound_baseline",
    """SELECT event_id, first_value(CASE WHEN value > 5 THEN event_type END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM events""",
)
def bound_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", temporal.bound_version("user_id", "event_id", "event_type", F.col("value") > 5).alias("bound"))


POLICY = cascade.Policy(medians=[20.0, 50.0], scales=[20.0, 30.0], centers=[20.0, 50.0], spreads=[20.0, 30.0], ood_threshold=4.0, conformal_quantile=0.4, hard_z=15.0, least_external=0.02, cooldown_seconds=48 * 3600)


def inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as inference rows: two features, a quality score from props, some broken on purpose."""
    k = F.get_json_object("props", "$.k").cast("double")
    df = read(spark, sf_dir, "events").withColumn("k", k)
    return df.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 41 == 0, F.array(F.col("value"))).when(F.col("event_id") % 43 == 0, F.array(F.lit(float("nan")), F.col("k"))).otherwise(F.array("value", "k")).alias("features"),
        F.when(F.col("event_id") % 47 != 0, F.col("value") / (F.col("value") + 20)).alias("probability"),
        F.when(F.col("event_id") % 53 == 0, "other").otherwise("model").alias("model_id"),
        (F.col("k") / 100).alias("external_quality"),
    )


CASCADE_STEPS = """WITH i AS (SELECT event_id AS seq, user_id AS session, ts, value AS f1, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_id AS e,
  CASE WHEN event_id % 47 <> 0 THEN value / (value + 20.0) END AS pr FROM events),
g AS (SELECT *, greatest(abs(f1 - 20.0) / 20.0, abs(k - 50.0) / 30.0) AS z, sqrt((pow((f1 - 20.0) / 20.0, 2) + pow((k - 50.0) / 30.0, 2)) / 2) AS d,
  1.0 / (1.0 + exp(-(ln(least(greatest(pr, 1e-7), 1 - 1e-7)) - ln(1 - least(greatest(pr, 1e-7), 1 - 1e-7))))) AS c FROM i),
h AS (SELECT *, CASE WHEN e % 53 = 0 OR e % 41 = 0 OR e % 43 = 0 OR k / 100 < 0.02 OR z >= 15 OR pr IS NULL THEN 'DATA_INVALID'
  WHEN d > 4 OR (CASE WHEN c <= 0.4 THEN 1 ELSE 0 END + CASE WHEN 1 - c <= 0.4 THEN 1 ELSE 0 END) <> 1 OR greatest(c, 1 - c) < 0.6 THEN 'OOD_OR_UNCERTAIN' END AS gate FROM g),
counted AS (SELECT *, sum(CASE WHEN c >= 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM h WHERE gate IS NULL),
live AS (SELECT *, coalesce(last_value(CASE WHEN c >= 0.65 AND n >= 2 THEN 1 WHEN c <= 0.45 THEN 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS active FROM counted)"""


@register("reliability_cascade", CASCADE_STEPS + """ SELECT seq, gate AS state FROM h WHERE gate IS NOT NULL
UNION ALL SELECT seq, CASE WHEN active THEN 'RELIABLE_ELEVATED' WHEN c > 0.45 THEN 'MONITOR' ELSE 'RELIABLE_LOW' END FROM live""")
def reliability_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.decide(inferences(spark, sf_dir), POLICY).select("seq", "state")


@register("quality_gate", """SELECT event_id AS seq, CASE WHEN event_id % 53 = 0 THEN 'MODEL_ID_MISMATCH' WHEN event_id % 41 = 0 THEN 'FEATURE_COUNT_INVALID' WHEN event_id % 43 = 0 THEN 'NONFINITE_FEATURE'
  WHEN CAST(json_extract(props, '$.k') AS DOUBLE) / 100 < 0.02 THEN 'EXTERNAL_QUALITY_LOW'
  WHEN greatest(abs(value - 20.0) / 20.0, abs(CAST(json_extract(props, '$.k') AS DOUBLE) - 50.0) / 30.0) >= 15 THEN 'FEATURE_OUT_OF_RANGE'
  WHEN event_id % 47 = 0 THEN 'PROBABILITY_INVALID' END AS reason FROM events""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade.gates(inferences(spark, sf_dir), POLICY)
    return out.select("seq", F.when(F.col("state") == "DATA_INVALID", F.element_at("reasons", 1)).alias("reason"))


@register("stream_temporal_states", f"WITH {ELEVATED} SELECT seq, session, active, state FROM states")
def stream_temporal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from relspark.streaming.sessions import run_available

    return run_available(spark, f"{sf_dir}/events.parquet")
