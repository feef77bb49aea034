"""Streams with control rows: the same events as the sessions, some of which steer them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.operators import temporal
from relspark.streaming import controlled

CONTROLLED = """c AS (SELECT event_id AS seq, user_id AS session, epoch_us(ts) - CASE WHEN event_id % 61 = 0 THEN 3 * 86400000000 ELSE 0 END AS us, value / (value + 20.0) AS p, event_id // 4000 AS epoch,
  CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_id % 89 = 0 THEN 'pause' WHEN event_id % 83 = 0 THEN 'resume' END AS command FROM events),
e AS (SELECT *, coalesce(epoch > lag(epoch) OVER (PARTITION BY session ORDER BY seq), false) AS turned FROM c),
g AS (SELECT *, sum(CASE WHEN turned OR command = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment,
  max(CASE WHEN turned OR command IN ('reset', 'resume') THEN seq END) OVER (PARTITION BY session) AS ended FROM e),
h AS (SELECT *, min(CASE WHEN command = 'pause' AND seq >= coalesce(ended, -1) THEN seq END) OVER (PARTITION BY session) AS waits FROM g),
t AS (SELECT *, coalesce(us < max(us) OVER (PARTITION BY session, segment ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM h WHERE command IS NULL AND (waits IS NULL OR seq < waits)),
n AS (SELECT *, sum(CASE WHEN p >= 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY session, segment ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM t WHERE NOT late),
a AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.65 AND n >= 2 THEN 1 WHEN p <= 0.45 THEN 0 END IGNORE NULLS) OVER (PARTITION BY session, segment ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS active FROM n),
j AS (SELECT *, lag(active, 1, false) OVER (PARTITION BY session, segment ORDER BY seq) AS before FROM a),
states AS (SELECT seq, session, active, CASE WHEN active THEN 'ELEVATED' WHEN p > 0.45 THEN 'MONITOR' ELSE 'LOW' END AS state FROM j UNION ALL SELECT seq, session, NULL, NULL FROM t WHERE late)"""


@register("controlled_states", f"WITH {CONTROLLED} SELECT * FROM states")
def controlled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's states as one batch plan: segments between resets, without the rows that a pause still holds."""
    from pyspark.sql import Window

    rows = controlled.controls(read(spark, sf_dir, "events"))
    whole = Window.partitionBy("session")
    order = whole.orderBy("seq")
    rows = rows.withColumn("turned", F.coalesce(F.col("epoch") > F.lag("epoch").over(order), F.lit(False)))
    ends = F.col("turned") | F.coalesce(F.col("command").isin("reset", "resume"), F.lit(False))
    rows = rows.withColumns({"segment": F.sum((F.col("turned") | F.coalesce(F.col("command") == "reset", F.lit(False))).cast("long")).over(order), "ended": F.max(F.when(ends, F.col("seq"))).over(whole)})
    rows = rows.withColumn("waits", F.min(F.when((F.col("command") == "pause") & (F.col("seq") >= F.coalesce("ended", F.lit(-1))), F.col("seq"))).over(whole))
    rows = rows.where(F.col("command").isNull() & (F.col("waits").isNull() | (F.col("seq") < F.col("waits"))))
    rows = rows.withColumn("late", temporal.out_of_order(["session", "segment"], "seq", "us"))
    judged = temporal.states(rows.where("NOT late"), ["session", "segment"])
    none = [F.lit(None).cast(t).alias(c) for c, t in (("active", "boolean"), ("state", "string"))]
    return judged.select("seq", "session", "active", "state").unionByName(rows.where("late").select("seq", "session", *none))


@register("stream_controlled_states", f"WITH {CONTROLLED} SELECT * FROM states")
def stream_controlled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlled.run_available(spark, f"{sf_dir}/events.parque[t]").where("kind = 'state'").select("seq", "session", "active", "state")


@register("stream_audit_events", f"""WITH {CONTROLLED} SELECT seq, session, upper(command) AS event FROM c WHERE command IS NOT NULL UNION ALL SELECT seq, session, 'RESET_ALL' FROM e WHERE turned
UNION ALL SELECT seq, session, 'LATE' FROM t WHERE late UNION ALL SELECT seq, session, CASE WHEN active THEN 'ACTIVATED' ELSE 'RELEASED' END FROM j WHERE active <> before""")
def stream_audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controlled.run_available(spark, f"{sf_dir}/events.parque[t]").where("kind = 'audit'").select("seq", "session", "event")
