"""Fits, metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import numeric
from relspark.operators import fit, metrics, stats

EV = "WITH e AS (SELECT event_id, user_id, ts, event_type, value / (value + 20.0) AS p, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y FROM events)"
BIN = "(SELECT count(*) FROM range(1, {n}) r(i) WHERE i * (1.0::DOUBLE / {n}) < p)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("event_type").isin("error", "purchase").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.col("value") / (F.col("value") + 20)).alias("p"), y.alias("y"))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("robust_profile", """WITH m AS (SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS med, stddev_samp(l_extendedprice) AS sd FROM lineitem GROUP BY 1),
d AS (SELECT l.l_returnflag, median(abs(l_extendedprice - med)) * 1.4826 AS mad FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1)
SELECT l_returnflag, n, round(med, 6) AS median, round(CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1.0 END, 6) AS scale FROM m JOIN d USING (l_returnflag)""")
def robust_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fit.robust_profile(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), "median", "scale")


@register("quantile_order_stats", """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(CASE WHEN k = CAST(ceil(0.99 * (n - 1)) AS BIGINT) + 1 THEN v END) AS higher_99, max(CASE WHEN k = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)) THEN v END) AS conformal_90 FROM r GROUP BY 1""")
def quantile_order_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    one = fit.order_statistic(df, "v", fit.higher_quantile(0.99), ["l_returnflag"]).select("l_returnflag", F.col("v").alias("higher_99"))
    two = fit.order_statistic(df, "v", fit.conformal_rank(0.1), ["l_returnflag"]).select("l_returnflag", F.col("v").alias("conformal_90"))
    return one.join(two, "l_returnflag")


@register("ood_scores", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, median(v) AS med, stddev_samp(v) AS sd FROM x GROUP BY i), d AS (SELECT x.i, median(abs(v - med)) * 1.4826 AS mad FROM x JOIN m USING (i) GROUP BY x.i),
s AS (SELECT i, med, CASE WHEN mad > 1e-8 THEN mad WHEN sd > 1e-8 THEN sd ELSE 1.0 END AS scale FROM m JOIN d USING (i))
SELECT vec_id, round(sqrt(avg(pow((v - med) / scale, 2))), 6) AS score FROM x JOIN s USING (i) GROUP BY vec_id""")
def ood_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = fit.long_form(df, "x", "vec_id")
    profile = F.broadcast(fit.robust_profile(rows, "value", ["feature"]))  # a row for each place of the vector
    z = (F.col("value") - F.col("median")) / F.col("scale")
    return rows.join(profile, "feature").groupBy("vec_id").agg(F.round(F.sqrt(F.avg(z * z)), 6).alias("score"))


@register("conformal_sets", EV + """, s AS (SELECT 1 - CASE WHEN y = 1 THEN p ELSE 1 - p END AS s FROM e), k AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM s),
q AS (SELECT max(s) AS q FROM k WHERE k = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)))
SELECT event_id, concat_ws(',', CASE WHEN 1 - (1 - p) <= q THEN 'nonstress' END, CASE WHEN 1 - p <= q THEN 'stress' END) AS prediction_set FROM e, q""")
def conformal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    q, p = fit.conformal_quantile(df, "y", "p", 0.1), F.col("p")
    return df.select("event_id", F.concat_ws(",", F.when(1 - (1 - p) <= q, "nonstress"), F.when(1 - p <= q, "stress")).alias("prediction_set"))


@register("calibration_metrics", EV + f""", b AS (SELECT event_type, y, least(greatest(p, 1e-7), 1 - 1e-7) AS c, p, {BIN.format(n=15)} AS bin FROM e),
g AS (SELECT event_type, bin, abs(sum(p) - sum(y)) AS gap FROM b GROUP BY ALL), h AS (SELECT event_type, sum(gap) AS gap FROM g GROUP BY 1)
SELECT event_type, count(*) AS n, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS nll, round(avg(pow(p - y, 2)), 6) AS brier, round(any_value(gap) / count(*), 6) AS ece FROM b JOIN h USING (event_type) GROUP BY event_type""")
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.calibration(scored(spark, sf_dir), "y", "p", 15, ["event_type"]), "nll", "brier", "ece")


@register("reliability_bins", EV + f""" SELECT {BIN.format(n=10)} AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM e GROUP BY 1""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.reliability_bins(scored(spark, sf_dir), "y", "p", 10), "mean_p", "rate").withColumn("bin", F.col("bin").cast("long"))


@register("confusion_by_group", EV + """, c AS (SELECT user_id % 10 AS g, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM e GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS prec, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rec FROM c)
SELECT g, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(prec, 6) AS precision, round(rec, 6) AS recall, round(CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END, 6) AS f1 FROM r""")
def confusion_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).withColumn("g", F.col("user_id") % 10)
    return r6(metrics.confusion(df, "y", F.col("p") >= 0.5, ["g"]), "accuracy", "precision", "recall", "f1")


@register("auroc_by_group", EV + """, r AS (SELECT user_id % 10 AS g, y, rank() OVER (PARTITION BY user_id % 10 ORDER BY p) + (count(*) OVER (PARTITION BY user_id % 10, p) - 1) / 2.0 AS k FROM e)
SELECT g, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auroc FROM r GROUP BY g""")
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.auroc(scored(spark, sf_dir).withColumn("g", F.col("user_id") % 10), "y", "p", ["g"]), "auroc")


@register("aurc", EV + """, c AS (SELECT event_type, event_id, greatest(p, 1 - p) AS conf, CASE WHEN (p >= 0.5) <> (y = 1) THEN 1 ELSE 0 END AS wrong FROM e),
r AS (SELECT event_type, avg(wrong) OVER w AS risk, event_id, conf, count(*) OVER (PARTITION BY event_type) AS n FROM c WINDOW w AS (PARTITION BY event_type ORDER BY conf DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT event_type, n, (risk + lag(risk) OVER (PARTITION BY event_type ORDER BY conf DESC, event_id)) / 2 / n AS a FROM r)
SELECT event_type, round(coalesce(sum(a), 0.0), 6) AS aurc, count(*) AS n FROM t GROUP BY event_type""")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    df = scored(spark, sf_dir).select("event_type", "event_id", F.greatest(p, 1 - p).alias("conf"), ((p >= 0.5) != (F.col("y") == 1)).cast("int").alias("wrong"))
    return r6(metrics.aurc(df, "wrong", "conf", "event_id", ["event_type"]), "aurc")


METHODS = {"raw": "true", "confident": "greatest(p, 1 - p) >= 0.6", "strict": "greatest(p, 1 - p) >= 0.8"}


@register("ablation_methods", EV + ", m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS method, user_id, y, p >= 0.5 AS pred, {c} AS acc FROM e" for n, c in METHODS.items()) + """)
SELECT method, user_id, count(*) AS n, count(*) FILTER (WHERE acc) AS accepted, count(*) FILTER (WHERE acc AND CAST(pred AS INT) <> y) AS wrong, round(count(*) FILTER (WHERE acc) / count(*), 6) AS coverage,
  round(CASE WHEN count(*) FILTER (WHERE acc) > 0 THEN count(*) FILTER (WHERE acc AND CAST(pred AS INT) <> y) / count(*) FILTER (WHERE acc) END, 6) AS risk FROM m GROUP BY method, user_id""")
def ablation_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.expr(c).alias("acc")) for n, c in METHODS.items()])).alias("m")
    df = scored(spark, sf_dir).select("user_id", "y", (F.col("p") >= 0.5).alias("pred"), rows).select("user_id", "y", "pred", "m.*")
    return r6(metrics.selective(df, "y", "pred", "acc", ["method", "user_id"]), "coverage", "risk")


@register("pooled_and_macro", EV + """, u AS (SELECT event_type, user_id, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM e GROUP BY 1, 2)
SELECT coalesce(event_type, 'all') AS event_type, round(sum(acc * n) / sum(n), 6) AS pooled, round(avg(acc), 6) AS macro, round(min(acc), 6) AS worst, round(median(acc), 6) AS middle FROM u GROUP BY GROUPING SETS ((event_type), ())""")
def pooled_and_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = ((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")
    users = scored(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg(hit).alias("acc"))
    out = users.rollup("event_type").agg((F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("pooled"), F.avg("acc").alias("macro"), F.min("acc").alias("worst"), F.percentile("acc", 0.5).alias("middle"))
    return r6(out.withColumn("event_type", F.coalesce("event_type", F.lit("all"))), "pooled", "macro", "worst", "middle")


@register("policy_alerts", EV + """, s AS (SELECT event_type, user_id, date_diff('microsecond', min(ts), max(ts)) / 3.6e9 AS h, count(*) FILTER (WHERE p >= 0.65) AS s, count(*) FILTER (WHERE p >= 0.65 AND y = 0) AS f FROM e GROUP BY 1, 2)
SELECT event_type, round(sum(h), 6) AS hours, CAST(sum(s) AS BIGINT) AS notifications, CAST(sum(f) AS BIGINT) AS false_notifications, round(CASE WHEN sum(h) > 0 THEN sum(f) / sum(h) END, 6) AS false_per_hour FROM s GROUP BY 1""")
def policy_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.alerts(scored(spark, sf_dir), "user_id", "ts", F.col("p") >= 0.65, F.col("y") == 0, ["event_type"]), "hours", "false_per_hour")


@register("threshold_search", EV + """, g AS (SELECT i, i / 100.0::DOUBLE AS t FROM range(0, 101) r(i))
SELECT CAST(i AS INT) AS i, count(*) FILTER (WHERE floor(p * 100 + 1e-9) >= i AND y = 1) AS tp, count(*) FILTER (WHERE floor(p * 100 + 1e-9) >= i AND y = 0) AS fp,
  round(CASE WHEN count(*) FILTER (WHERE floor(p * 100 + 1e-9) >= i) + sum(y) = 0 THEN 0.0 ELSE 2.0 * count(*) FILTER (WHERE floor(p * 100 + 1e-9) >= i AND y = 1) / (count(*) FILTER (WHERE floor(p * 100 + 1e-9) >= i) + sum(y)) END, 6) AS f1 FROM g, e GROUP BY i""")
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(metrics.threshold_search(scored(spark, sf_dir), "y", "p", 101), "f1")


@register("temperature_fit")
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fit.logits(scored(spark, sf_dir), "p").select("x", "y")
    t = fit.temperature(df, "y", "x")
    return df.agg(F.lit(round(t, 4)).alias("temperature"), F.round(metrics.nll(F.col("y"), numeric.temperature(F.col("x"), t)), 6).alias("nll"))


@register("platt_fit")
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fit.logits(scored(spark, sf_dir), "p").select("x", "y")
    a, b = fit.platt(df, "y", "x")
    return df.agg(F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"), F.round(metrics.nll(F.col("y"), numeric.platt(F.col("x"), a, b)), 6).alias("nll"))


@register("group_stats", """SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount > 0) AS n, round(avg(l_discount) FILTER (WHERE l_discount > 0), 6) AS mean, round(coalesce(stddev_samp(l_discount) FILTER (WHERE l_discount > 0), 0.0), 6) AS sd,
  min(l_discount) FILTER (WHERE l_discount > 0) AS low, max(l_discount) FILTER (WHERE l_discount > 0) AS high FROM lineitem GROUP BY 1, 2""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.describe(read(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag", "l_linestatus"]), "mean", "sd")


@register("welch_t", """WITH g AS (SELECT l_linenumber, count(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS n1, count(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m2,
  var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v2 FROM lineitem GROUP BY 1)
SELECT l_linenumber, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) AS df FROM g""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.welch(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", ["l_linenumber"]), "t", "df")


@register("cohens_d", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings),
s AS (SELECT feature, avg(v) FILTER (WHERE label % 2 = 1) AS a, avg(v) FILTER (WHERE label % 2 = 0) AS b, sqrt((var_pop(v) FILTER (WHERE label % 2 = 1) + var_pop(v) FILTER (WHERE label % 2 = 0)) / 2) AS s FROM x GROUP BY 1)
SELECT CAST(feature AS INT) AS feature, round(abs(a - b) / CASE WHEN s = 0 THEN 1e-10 ELSE s END, 6) AS d FROM s""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fit.long_form(read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("x")), "x", "label")
    return r6(stats.cohens_d(rows, "value", F.col("label") % 2 == 1, ["feature"]), "d")


COV = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("covariance", " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_samp({COV[i]}, {COV[j]}), 6) AS cov FROM lineitem" for i in range(4) for j in range(i, 4)))
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.covariance(read(spark, sf_dir, "lineitem"), COV), "cov")


@register("pearson_length", """SELECT lang, count(*) AS n, round(CASE WHEN var_pop(n_chars) > 0 AND var_pop(quality) > 0 THEN covar_pop(n_chars, quality) / sqrt(var_pop(n_chars) * var_pop(quality)) ELSE 0.0 END, 6) AS r FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def pearson_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.round(stats.pearson(F.col("n_chars").cast("double"), F.col("quality").cast("double")), 6).alias("r"))


@register("difficulty_weighted", """WITH u AS (SELECT user_id, count(*) AS n, avg(value) AS v, stddev_pop(value) / greatest(avg(value), 1e-9) AS d FROM events GROUP BY 1), w AS (SELECT *, 1 / ln(1 + greatest(d, 0.01)) AS w FROM u)
SELECT CASE WHEN d < 0.8 THEN 'hard' WHEN d < 1.5 THEN 'medium' ELSE 'easy' END AS difficulty, count(*) AS users, round(sum(w * v) / sum(w), 6) AS weighted, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM w GROUP BY 1""")
def difficulty_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.stddev_pop("value") / F.greatest(F.avg("value"), F.lit(1e-9))
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("v"), d.alias("d"))
    u = u.withColumn("w", 1 / F.log(1 + F.greatest(F.col("d"), F.lit(0.01))))
    out = u.groupBy(numeric.difficulty(F.col("d")).alias("difficulty")).agg(F.count("*").alias("users"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("weighted"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return r6(out, "weighted", "mean", "sd")


@register("method_deltas", EV + """, m AS (SELECT user_id % 5 AS fold, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS base, avg(CASE WHEN (p >= 0.65) = (y = 1) THEN 1.0 ELSE 0.0 END) AS other FROM e GROUP BY 1)
SELECT round(avg(base), 6) AS base, round(avg(other), 6) AS other, round(avg(other) - avg(base), 6) AS delta, count(*) FILTER (WHERE other > base) AS improved FROM m""")
def method_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold averages of two methods and their difference."""
    right = lambda t: F.avg(((F.col("p") >= t) == (F.col("y") == 1)).cast("double"))
    folds = scored(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("fold")).agg(right(0.5).alias("base"), right(0.65).alias("other"))
    out = folds.agg(F.avg("base").alias("base"), F.avg("other").alias("other"), (F.avg("other") - F.avg("base")).alias("delta"), metrics.count(F.col("other") > F.col("base")).alias("improved"))
    return r6(out, "base", "other", "delta")


@register("feature_importance", """SELECT CAST(i - 1 AS INT) AS feature, round(avg(abs(v)), 6) AS importance FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1""")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fit.long_form(read(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")), "x")
    return rows.groupBy("feature").agg(F.round(F.avg(F.abs("value")), 6).alias("importance"))


@register("top_drivers", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i DESC) AS r FROM x)
SELECT vec_id, string_agg(i, ',' ORDER BY r) AS drivers FROM r WHERE r <= 3 GROUP BY 1""")
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the three largest values by size; of equal ones the later place first. Within a row: no shuffle."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.struct(F.abs(v).alias("a"), i.alias("i")))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.sort_array(x, asc=False), 1, 3), lambda s: s["i"].cast("string")), ",").alias("drivers"))


@register("label_prior", EV + " SELECT event_type, round(avg(y), 6) AS prior, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 6) AS iqr FROM e GROUP BY 1")
def label_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("p", F.array(F.lit(0.25), F.lit(0.75)))
    return r6(scored(spark, sf_dir).groupBy("event_type").agg(F.avg("y").alias("prior"), (q[1] - q[0]).alias("iqr")), "prior", "iqr")
