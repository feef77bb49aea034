"""Sources and sinks: tables written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import numeric as N
from relspark.operators import audit, metrics, prepare
from relspark.operators.storage import new_folder
from relspark.sources import readers, writers


@register("json_lines_files", "SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def json_lines_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines by role, read back with a schema that a line must fit."""
    path = new_folder(spark, "turns.jsonl")
    turns = read(spark, sf_dir, "conversations")
    writers.json_lines(turns, path, ["role"])
    return readers.records(spark, path, turns.schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"))


@register("csv_files", "SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) AS price, printf('%.4f', l_tax) AS tax, l_quantity * 2 AS twice FROM lineitem")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as CSV with fixed places, read back as text; numbers are made of the text."""
    path = new_folder(spark, "lines")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), "l_quantity")
    writers.csv(lines, path, {"price": 2, "tax": 4})
    df = readers.require(readers.records(spark, path), ["l_orderkey", "price", "tax"], path)
    return df.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "price", "tax", (readers.number(F.col("l_quantity")) * 2).alias("twice"))


@register("quoted_csv_files", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id IS NOT NULL")
def quoted_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line ends, quotes and commas through CSV; an empty text comes back null."""
    path = new_folder(spark, "texts")
    writers.csv(read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "text"), path)
    return readers.records(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


WIDTH = 12


@register("subject_files", """SELECT 'supplier-' || l_suppkey AS subject, count(*) AS n, sum(CAST(l_quantity > 25 AS INT)) AS positives, round(sum(l_quantity * 6 + l_linenumber * 66), 2) AS total FROM lineitem GROUP BY 1""")
def subject_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with parallel arrays for each supplier's lines, read back row by row with its features checked."""
    place = F.sequence(F.lit(1), F.lit(WIDTH))
    one = F.struct(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("label"), F.transform(place, lambda i: F.col("l_quantity") / 2 + F.col("l_linenumber") * (i - 1)).alias("features"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_list(one).alias("x"))  # a file's own rows
    body = F.to_json(F.struct(F.col("x.id").alias("id"), F.col("x.label").alias("label"), F.col("x.features").alias("features")))
    folder = new_folder(spark, "subjects")
    writers.pages(rows.select(F.concat(F.lit("supplier-"), "l_suppkey", F.lit(".json")).alias("name"), body.alias("page")), writers.uri(folder))
    df = readers.subject_rows(spark, folder, WIDTH)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return df.groupBy("subject").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.round(F.sum(total), 2).alias("total"))


@register("text_files", "SELECT sha256(text) AS digest, count(*) AS n FROM benchmark WHERE regexp_matches(text, '\\S') GROUP BY 1")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each benchmark item, found again below their folder; blank ones are left out."""
    folder = new_folder(spark, "items")
    items = read(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    writers.pages(items.select(F.concat(F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, ".md").otherwise(".txt")).alias("name"), F.col("text").alias("page")), writers.uri(folder))
    return readers.text_folder(spark, folder).groupBy(F.sha2("content", 256).alias("digest")).agg(F.count("*").alias("n"))


@register("source_aliases", """WITH s AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS q, o_orderpriority AS t, o_orderstatus AS a FROM orders),
i AS (SELECT o, CASE WHEN q = '' THEN CAST(o AS VARCHAR) ELSE q END AS id, t, a FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM i)
SELECT CASE WHEN k > 1 THEN id || ':answer-' || k ELSE id END AS source_id, t AS question, a AS answer, 'general' AS topic, 'orders' AS source, 'CC0' AS license FROM r""")
def source_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders under other names as questions and answers; an empty id is the order's own key, repeated ids are numbered."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey").cast("string")).otherwise("").alias("questionID"), F.col("o_orderpriority").alias("questionText"), F.col("o_orderstatus").alias("answerText"))
    return readers.source_records(df, "orders", "CC0", "o_orderkey")


@register("prediction_columns", """SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN value / 256 END AS probability, CASE WHEN event_id % 5 = 1 THEN value / 64 END AS logit,
  'u' || user_id AS subject, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS label, CASE WHEN event_id % 3 > 0 THEN value END AS first, event_id % 3 AS second FROM events""")
def prediction_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions, features and task names as text: exactly one of probability and logit counts, features come as JSON."""
    features = F.to_json(F.array(F.when(F.col("event_id") % 3 > 0, F.col("value")), (F.col("event_id") % 3).cast("double")), {"ignoreNullFields": "false"})
    kind = F.col("event_id") % 5
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("u"), "user_id", F.lit("_"), "event_type").alias("task"), F.when(F.col("event_type") == "error", "1").otherwise("0").alias("binary_stress"),
        F.when(kind == 1, "").when(kind == 2, "n/a").otherwise((F.col("value") / 256).cast("string")).alias("raw_probability"),
        F.when(kind.isin(1, 3), (F.col("value") / 64).cast("string")).alias("raw_logit"), features.alias("features"),
    )
    out = readers.task_labels(readers.prediction(rows)).withColumn("x", readers.feature_array(rows, ["value"]))
    return out.select("event_id", "probability", "logit", "subject", "label", F.col("x")[0].alias("first"), F.col("x")[1].cast("long").alias("second"))


@register("signal_files", "SELECT count(value) AS n, round(sum(value), 3) AS total, max(value) AS top FROM events WHERE event_id % 4 <> 0")
def signal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal's column from a CSV file; its empty cells are left out."""
    path = new_folder(spark, "signal")
    writers.csv(read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("ecg")), path)
    return readers.signal_column(spark, path, "ecg").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("top"))


@register("quarantined_rows", """WITH m AS (SELECT l_returnflag, concat_ws(',', CASE WHEN l_quantity > 48 THEN 'QUANTITY_HIGH' END, CASE WHEN l_discount = 0 THEN 'DISCOUNT_MISSING' END, CASE WHEN l_shipdate >= TIMESTAMP '1998-06-01' THEN 'DATE_LATE' END) AS codes FROM lineitem)
SELECT l_returnflag, codes, count(*) AS n FROM m GROUP BY 1, 2""")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept (no code) and rows split off, counted by their codes."""
    kept, rejected = audit.quarantine(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_shipdate"), {"QUANTITY_HIGH": F.col("l_quantity") > 48, "DISCOUNT_MISSING": F.col("l_discount") == 0, "DATE_LATE": F.expr("l_shipdate >= TIMESTAMP_NTZ '1998-06-01'")})
    rows = kept.select("l_returnflag", F.lit("").alias("codes")).unionByName(rejected.select("l_returnflag", F.array_join("issues", ",").alias("codes")))
    return rows.groupBy("l_returnflag", "codes").agg(F.count("*").alias("n"))


FOLDED = ["l_suppkey % 5 AS fold", "CASE WHEN l_extendedprice * (1 - l_discount) > 30000 THEN 1 ELSE 0 END AS predicted", "1 + l_linenumber % 4 AS condition"]


@register("fold_confusion", f"""WITH r AS (SELECT {', '.join(FOLDED)} FROM lineitem WHERE l_linenumber < 7 AND NOT (l_suppkey % 5 = 4 AND l_linenumber = 2)),
c AS (SELECT fold, p, k, 100.0 * count(*) FILTER (WHERE predicted = p AND condition = k) / count(*) AS pct FROM r, (VALUES (1), (0)) AS a(p), (VALUES (1), (2), (3), (4)) AS b(k) GROUP BY 1, 2, 3),
s AS (SELECT fold, p, CAST(k = 2 AS INT) AS k, sum(pct) AS pct FROM c GROUP BY ALL)
SELECT 'conditions' AS kind, p AS predicted, k AS label, round(avg(pct), 4) AS mean, round(stddev_pop(pct), 4) AS std FROM c GROUP BY ALL UNION ALL SELECT 'labels', p, k, round(avg(pct), 4), round(stddev_pop(pct), 4) FROM s GROUP BY ALL""")
def fold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of predictions by condition and by label over folds; one condition never occurs in one fold."""
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber < 7 AND NOT (l_suppkey % 5 = 4 AND l_linenumber = 2)").selectExpr(*FOLDED)
    both = [("conditions", "condition", [1, 2, 3, 4]), ("labels", F.expr("cast(condition = 2 AS int)"), [0, 1])]
    out = [metrics.fold_confusion(rows, "fold", "predicted", label, [1, 0], values).withColumn("kind", F.lit(kind)) for kind, label, values in both]
    return out[0].unionByName(out[1]).select("kind", "predicted", "label", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@register("baseline_vectors", """WITH b AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d, sum(CASE WHEN l_suppkey % 6 = 0 THEN 0 ELSE l_linenumber END) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
w AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(l_quantity) AS q, avg(l_discount) AS d, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
SELECT w.l_suppkey, CAST(w.y AS INT) AS y, round(w.q / b.q, 6) AS q, round(w.d / nullif(b.d, 0), 6) AS d, round(w.n / nullif(b.n, 0), 6) AS n FROM w LEFT JOIN b USING (l_suppkey)""")
def baseline_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' yearly features over their baseline; a baseline of zero gives null."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity", "l_discount", "l_linenumber", "l_returnflag")
    vector = lambda n: F.array(F.avg("l_quantity"), F.avg("l_discount"), F.sum(n).cast("double"))
    base = lines.where("l_returnflag = 'N'").groupBy("l_suppkey").agg(vector(F.when(F.col("l_suppkey") % 6 == 0, 0).otherwise(F.col("l_linenumber"))).alias("base"))
    out = prepare.over_baseline(lines.groupBy("l_suppkey", "y").agg(vector("l_linenumber").alias("features")), base, ["l_suppkey"], "features", "base")
    return out.select("l_suppkey", "y", *[F.round(F.col("features")[i], 6).alias(c) for i, c in enumerate(("q", "d", "n"))])


@register("resampled_places", "SELECT event_id, CAST(round_even(event_id * 700 / 1000.0, 0) AS BIGINT) AS place FROM events")
def resampled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of samples at 1000 a second among those at 700, halves to even."""
    return read(spark, sf_dir, "events").select("event_id", N.resample_index(F.col("event_id"), 1000, 700).alias("place"))
