"""Preparation of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import hashing
from relspark.operators import prepare


@register("outlier_trim", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b, quantile_cont(l_quantity, 0.01) AS c, quantile_cont(l_quantity, 0.99) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice BETWEEN a AND b AND l_quantity BETWEEN c AND d""")
def outlier_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_quantity")
    return prepare.trim(df, ["l_returnflag"], ["l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_returnflag")


@register("class_balance", """WITH s AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT min(CASE WHEN l_returnflag = 'N' THEN n ELSE 3 * n END) AS prop FROM s),
d AS (SELECT l_returnflag, CAST(ceil(n / greatest(CASE WHEN l_returnflag = 'N' THEN prop ELSE floor(0.333 * prop) END, 1)) AS BIGINT) AS stride FROM s, t),
r AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag FROM r JOIN d USING (l_returnflag) WHERE i % stride = 0""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return prepare.balance(df, "l_returnflag", "N", order).select("l_orderkey", "l_linenumber", "l_returnflag")


@register("baseline_ratio", """WITH m AS (SELECT user_id, median(value) FILTER (WHERE event_type = 'view') AS a, median(value) AS b FROM events GROUP BY 1)
SELECT event_id, round(value / greatest(coalesce(a, b, 1.0), 1e-8), 6) AS value_ratio FROM events JOIN m USING (user_id)""")
def baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return prepare.baseline_ratio(df, ["user_id"], F.col("event_type") == "view", ["value"]).select("event_id", F.round("value_ratio", 6).alias("value_ratio"))


@register("label_windows", """WITH l AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN 2 ELSE 1 END AS label FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(label) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM l)
SELECT user_id, event_id AS start, label FROM w WHERE i % 2 = 0 AND i < n - 3 AND s = label * 3""")
def label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 20, 2).otherwise(1).alias("label"))
    return prepare.label_windows(df, "user_id", "event_id", "label", 3, 2)


@register("signal_windows", """WITH w AS (SELECT vec_id, i, embedding[i + 1 : i + 16] AS w FROM embeddings, range(0, 49, 8) r(i))
SELECT vec_id, i // 8 AS n, round(list_avg(w::DOUBLE[]), 6) AS mean FROM w""")
def signal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(prepare.signal_windows(F.col("embedding").cast("array<double>"), 16, 8)).alias("n", "w"))
    return df.select("vec_id", F.col("n").cast("long").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / 16, 6).alias("mean"))


@register("strata_bins", "SELECT c_custkey, c_mktsegment, CAST(ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS INT) AS bin FROM customer")
def strata_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return prepare.equal_bins(df, "c_acctbal", "c_custkey", 5, ["c_mktsegment"]).drop("c_acctbal")


@register("stratified_split", """SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('42:' || c_custkey), c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2 + 0.5) AS chosen FROM customer""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.stratified_split(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 0.2).select("c_custkey", "chosen")


@register("loso_folds", """WITH p AS (SELECT a.n_nationkey AS evaluated, b.n_nationkey AS subject FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey)
SELECT *, CASE WHEN row_number() OVER (PARTITION BY evaluated ORDER BY sha256('5101:' || evaluated || ':' || subject), subject) <= count(*) OVER (PARTITION BY evaluated) // 2 THEN 'reference' ELSE 'calibration' END AS role FROM p""")
def loso_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.leave_one_out(read(spark, sf_dir, "nation"), "n_nationkey")


@register("subject_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE b.n_nationkey < 4")
def subject_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey").where("n_nationkey < 4")
    return n.select(F.col("n_nationkey").alias("a")).join(n.select(F.col("n_nationkey").alias("b")), F.expr("a < b"))


@register("hash_split", """SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256('5101:' || source), 1, 8))::BIGINT % 100 AS b FROM documents)""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", hashing.split_name(F.col("source")).alias("split"))


@register("quota_sample", """WITH p AS (SELECT lang, count(*) AS n, greatest(1, floor(100 * count(*) / (SELECT count(*) FROM documents))) AS q FROM documents GROUP BY 1),
s AS (SELECT lang, q + CASE WHEN row_number() OVER (ORDER BY n DESC, lang) = 1 THEN greatest(100 - sum(q) OVER (), 0) ELSE 0 END AS q FROM p),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r JOIN s USING (lang) WHERE r <= q""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.quota_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


@register("source_moments", """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS m1, round(avg(l_extendedprice), 6) AS m2, round(covar_samp(l_quantity, l_extendedprice), 4) AS c12 FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def source_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("m1"), F.round(F.avg("l_extendedprice"), 6).alias("m2"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("c12"))


@register("coral_align")
def coral_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned rows in the domain of kept ones: moments of the result are the target's."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *columns)
    source, target = df.where("l_returnflag = 'R'"), df.where("l_returnflag = 'N'")
    return prepare.coral(source, columns, prepare.moments(source, columns), prepare.moments(target, columns))


@register("disjoint_subjects", """SELECT 'overlap' AS check_name, count(*) AS n FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 10 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 8)
UNION ALL SELECT 'remaining', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 10)""")
def disjoint_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    one, two = n.where("n_nationkey < 10"), n.where("n_nationkey > 8")
    return one.intersect(two).agg(F.lit("overlap").alias("check_name"), F.count("*").alias("n")).unionByName(n.subtract(one).agg(F.lit("remaining").alias("check_name"), F.count("*").alias("n")))


@register("status_counters", """WITH s AS (SELECT CASE WHEN value IS NULL THEN 'missing' WHEN NOT isfinite(value) THEN 'not_finite' WHEN value > 100 THEN 'noisy' ELSE 'ok' END AS status FROM events) SELECT status, count(*) AS n FROM s GROUP BY 1""")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v.isNull(), "missing").when(F.isnan(v) | (F.abs(v) == float("inf")), "not_finite").when(v > 100, "noisy").otherwise("ok")
    return read(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@register("noisy_to_prior", """WITH m AS (SELECT median(value) AS med, median(abs(value - (SELECT median(value) FROM events))) * 1.4826 AS s FROM events), p AS (SELECT avg(value / (value + 20.0)) AS prior FROM events)
SELECT event_id, round(CASE WHEN abs(value - med) / s > 6 THEN prior ELSE value / (value + 20.0) END, 6) AS score FROM events, m, p""")
def noisy_to_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of rows beyond six robust deviations become the mean score; the three fitted numbers are literals."""
    df = read(spark, sf_dir, "events").select("event_id", "value", (F.col("value") / (F.col("value") + 20)).alias("p"))
    med, prior = df.agg(F.percentile("value", 0.5), F.avg("p")).first()
    mad = df.agg(F.percentile(F.abs(F.col("value") - med), 0.5)).first()[0] * 1.4826
    return df.select("event_id", F.round(F.when(F.abs(F.col("value") - med) / mad > 6, F.lit(prior)).otherwise(F.col("p")), 6).alias("score"))
