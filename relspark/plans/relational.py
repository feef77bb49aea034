"""The plain relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relspark.catalog import read, register


@register("scan_filter_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 45")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1998-01-01' AND l_quantity > 45")
    return df.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@register("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@register("nation_revenue", """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read(spark, sf_dir, n)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))  # before the join: a row an order
    sold = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("net").alias("net"), F.count("*").alias("orders"))
    out = sold.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return out.groupBy("r_name", "n_name").agg(F.round(F.sum("net"), 2).alias("revenue"), F.sum("orders").alias("orders"))


@register("left_lookup", """SELECT c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return read(spark, sf_dir, "customer").join(top, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top")


@register("semi_anti", """SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda how, name: c.join(o, "c_custkey", how).agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@register("union_intersect_except", """SELECT 'union' AS kind, count(*) AS n FROM (SELECT n_nationkey FROM nation UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'all', (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def union_intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count(a.union(b).distinct(), "union").unionByName(count(a.union(b), "all")).unionByName(count(a.intersect(b), "intersect")).unionByName(count(a.subtract(b), "except"))


@register("top_k_by_group", """SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_k_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("o_totalprice")


@register("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@register("best_and_worst", """WITH m AS (SELECT p_brand, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') - avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT arg_max(p_brand, d) AS best, arg_min(p_brand, d) AS worst, round(max(d), 4) AS high, round(min(d), 4) AS low FROM m""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    of = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice")))
    m = lines.groupBy("p_brand").agg((of("A") - of("R")).alias("d"))
    return m.agg(F.max_by("p_brand", "d").alias("best"), F.min_by("p_brand", "d").alias("worst"), F.round(F.max("d"), 4).alias("high"), F.round(F.min("d"), 4).alias("low"))


@register("pivot_confusion", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS "O", count(*) FILTER (WHERE l_linestatus = 'F') AS "F" FROM lineitem GROUP BY 1""")
def pivot_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().na.fill(0)


@register("first_difference", """SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events""")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"), F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6).alias("smooth"))
