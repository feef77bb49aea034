"""Signals: events as beat intervals of a user's ten days, and as one long signal by event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.operators import signals

DAYS = 10
BEATS = f"""b AS (SELECT user_id, CAST(floor(epoch(ts) / {86400 * DAYS}) AS BIGINT) AS span, 0.4 + least(value, 160) / 200 AS x, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / {86400 * DAYS}) ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT user_id, span, count(*) AS n, avg(x) AS rr_mean, stddev_pop(x) AS rr_sd, sqrt(avg(x * x)) AS rms, avg(1 / x) AS rate_mean, stddev_pop(1 / x) AS rate_sd, stddev_samp(x) AS sd, min(x) AS low, max(x) AS high FROM b GROUP BY ALL)"""
PULSE_SQL = f"""WITH {BEATS},
near AS (SELECT a.user_id, a.span, greatest(count(*) FILTER (WHERE abs(a.x - c.x) > 0.05), 1) AS nn50 FROM b a JOIN b c USING (user_id, span) GROUP BY ALL),
wave AS (SELECT user_id, span, k, 2.0 / n * sqrt(pow(sum((x - rr_mean) * cos(2 * pi() * k * i / n)), 2) + pow(sum((x - rr_mean) * sin(2 * pi() * k * i / n)), 2)) AS p, k / (n * rr_mean) AS f
  FROM b JOIN s USING (user_id, span), range(n // 2) AS r(k) GROUP BY user_id, span, k, n, rr_mean),
freq AS (SELECT user_id, span, avg(f) AS freq_mean, stddev_pop(f) AS freq_sd, sum(p) AS power_sum FROM wave GROUP BY ALL),
grid AS (SELECT user_id, span, n, g, low + g * (high - low) / (n - 1) AS at, sd * pow(n, -0.2) AS h FROM s, range(n) AS r(g) WHERE n >= 3 AND sd > 0),
density AS MATERIALIZED (SELECT g.user_id, g.span, g.n, g.g, g.at, sum(exp(-0.5 * pow((g.at - b.x) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())) AS d FROM grid g JOIN b USING (user_id, span) GROUP BY g.user_id, g.span, g.n, g.g, g.at, g.h),
top AS (SELECT user_id, span, n, arg_max(g, d) AS p, max(d) AS d FROM density GROUP BY ALL),
feet AS (SELECT t.user_id, t.span, f.f, sign(t.p - f.f) AS side, y.g, pow(y.d - t.d * greatest(0, (y.g - f.f) / (t.p - f.f)), 2) AS e FROM top t, range(t.n) AS f(f), density y
  WHERE t.p BETWEEN 1 AND t.n - 2 AND f.f <> t.p AND y.user_id = t.user_id AND y.span = t.span AND (f.f < t.p AND y.g <= t.p OR f.f > t.p AND y.g >= t.p)),
fits AS (SELECT user_id, span, f, side, sum(pow((e + next) / 2, 2)) AS e FROM (SELECT *, lead(e) OVER (PARTITION BY user_id, span, f ORDER BY g) AS next FROM feet) WHERE next IS NOT NULL GROUP BY ALL),
ends AS (SELECT user_id, span, arg_min(f, e) FILTER (WHERE side = 1) AS l, arg_min(f, e) FILTER (WHERE side = -1) AS r FROM fits GROUP BY ALL),
tri AS (SELECT e.user_id, e.span, (e.r - e.l) * (s.high - s.low) / (s.n - 1) AS tinn, s.n / t.d AS triangular_index FROM ends e JOIN top t USING (user_id, span) JOIN s USING (user_id, span))
SELECT user_id, span, n AS beats, CASE WHEN n < 3 THEN 'TOO_FEW_INTERVALS' WHEN tinn IS NULL THEN 'TOO_LITTLE_VARIATION' END AS problem, CASE WHEN tinn IS NOT NULL THEN nn50 END AS nn50, round(CASE WHEN tinn IS NOT NULL THEN nn50 / (n * n) END, 6) AS pnn50,
  {", ".join(f"round(CASE WHEN tinn IS NOT NULL THEN {c} END, 6) AS {c}" for c in signals.PULSE if c not in ("nn50", "pnn50"))}
FROM s JOIN near USING (user_id, span) LEFT JOIN freq USING (user_id, span) LEFT JOIN tri USING (user_id, span)"""


@register("pulse_features", PULSE_SQL)
def pulse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.floor(F.unix_micros("ts") / (86400 * DAYS * 1_000_000)).cast("long")
    beats = df.groupBy("user_id", span.alias("span")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (0.4 + F.least("value", F.lit(160.0)) / 200).alias("x")))).alias("b"))  # a user's ten days
    out = signals.pulse_features(beats.select("user_id", "span", F.col("b.x").alias("beats")), "beats")
    return out.select("user_id", "span", F.size("beats").cast("long").alias("beats"), "problem", F.col("nn50").cast("long").alias("nn50"), *[(F.round(F.col(c) * 1e6) / 1e6).alias(c) for c in signals.PULSE if c != "nn50"])  # DuckDB rounds the product


@register("signal_peaks", """WITH z AS (SELECT event_id AS i, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events),
s AS (SELECT i, sum(z) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM z), m AS (SELECT i, s, avg(s) OVER () AS base FROM s),
r AS (SELECT *, sum(CASE WHEN s < base THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT arg_max(i, s) AS peak, round(max(s), 6) AS height FROM r WHERE s > base GROUP BY run HAVING max(s) > 0.3""")
def signal_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select(F.lit("events").alias("signal"), "event_id", "value")
    return signals.peaks(df, ["signal"], "event_id", "value", 0.3).select("peak", F.round("height", 6).alias("height"))


BESSEL = "list_sum(list_transform(range(30), lambda j: pow(pow({z} / 2, j) / factorial(j::INTEGER), 2)))"


@register("resampled_signal", f"""WITH k AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3) / (pi() * k / 3) END * {BESSEL.format(z="(5 * sqrt(1 - pow(k / 30, 2)))")} / {BESSEL.format(z="5.0")} AS h FROM range(-30, 31) AS r(k)),
h AS (SELECT k, 3 * h / sum(h) OVER () AS h FROM k), m AS (SELECT m FROM range((SELECT CAST(ceil((max(event_id) + 1) * 3 / 2) AS BIGINT) FROM events)) AS r(m))
SELECT m.m AS position, round(sum(coalesce(e.value, 0) * h.h), 6) AS value FROM m JOIN h ON (2 * m.m - h.k) % 3 = 0 LEFT JOIN events e ON e.event_id = (2 * m.m - h.k) // 3 AND 2 * m.m - h.k >= 0 GROUP BY 1""")
def resampled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values at three halves of their rate."""
    df = read(spark, sf_dir, "events").select(F.lit("events").alias("signal"), F.col("event_id").alias("position"), "value")
    return signals.resampled(df, ["signal"], "position", "value", 200, 300).select("position", F.round("value", 6).alias("value"))
