"""Cleaning, duplicates, audits and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.catalog import read, register
from relspark.functions import hashing
from relspark.functions import text as T
from relspark.operators import audit, dedup, retrieval

TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+')"
DOCS = f"WITH w AS (SELECT doc_id, source, lang, text, {TOK} AS w FROM documents)"
SETS = DOCS + """, s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) END AS s FROM w),
r AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM s GROUP BY 2), x AS (SELECT rep, len(s) AS n, unnest(s) AS h FROM r),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2),
p AS (SELECT a, b, c / (na + nb - c) AS similarity FROM o WHERE c / (na + nb - c) >= 0.9)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", T.tokens(F.col("text")).alias("w"))


def shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.shingles(F.col("w")).alias("s"))


@register("normalized_text", DOCS + " SELECT doc_id, sha256(array_to_string(w, ' ')) AS fingerprint, len(w) AS n FROM w")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("fingerprint"), F.size("w").cast("long").alias("n"))


@register("exact_duplicates", DOCS + ", f AS (SELECT doc_id, sha256(array_to_string(w, ' ')) AS fingerprint FROM w) SELECT doc_id, fingerprint, copies, first FROM f JOIN (SELECT fingerprint, count(*) AS copies, min(doc_id) AS first FROM f GROUP BY 1 HAVING count(*) > 1) USING (fingerprint)")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(normalized_text(spark, sf_dir), "doc_id", "fingerprint")


@register("near_duplicate_pairs", SETS + " SELECT a, b, round(similarity, 6) AS similarity FROM p")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps, _ = dedup.classes(shingled(spark, sf_dir), "doc_id", "s")
    return dedup.similar_pairs(reps, 0.9).withColumn("similarity", F.round("similarity", 6))


@register("duplicate_clusters", SETS.replace("WITH w", "WITH RECURSIVE w", 1) + """, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT rep AS node, rep AS root FROM r UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node), l AS (SELECT node, min(root) AS root FROM c GROUP BY 1)
SELECT s.doc_id, l.root AS cluster FROM s JOIN r ON r.s = list_sort(s.s) JOIN l ON l.node = r.rep""")
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.clusters(shingled(spark, sf_dir), "doc_id", "s", 0.9)


@register("split_leakage", DOCS + """, f AS (SELECT sha256(array_to_string(w, ' ')) AS fingerprint, ('0x' || substr(sha256('5101:' || doc_id), 1, 8))::BIGINT % 100 AS b FROM w)
SELECT fingerprint, count(DISTINCT CASE WHEN b < 80 THEN 1 WHEN b < 90 THEN 2 ELSE 3 END) AS splits, count(*) AS rows FROM f GROUP BY 1 HAVING count(DISTINCT CASE WHEN b < 80 THEN 1 WHEN b < 90 THEN 2 ELSE 3 END) > 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.leakage(normalized_text(spark, sf_dir).withColumn("split", hashing.split_name(F.col("doc_id"))), "fingerprint", "split")


@register("contamination", """WITH d AS (SELECT doc_id, """ + TOK + """ AS w FROM documents), b AS (SELECT item_id, """ + TOK + """ AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2""")
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = lambda df, k: df.select(k, T.tokens(F.col("text")).alias("w")).where("size(w) >= 8").select(k, T.shingles(F.col("w"), 8).alias(f"s_{k}"))
    return dedup.contamination(eight(read(spark, sf_dir, "documents"), "doc_id"), "doc_id", "s_doc_id", eight(read(spark, sf_dir, "benchmark"), "item_id"), "item_id", "s_item_id")


@register("first_seen_dedupe", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY substr(lower(text), 1, 100) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", "source", F.substring(F.lower("text"), 1, 100).alias("head"))
    return dedup.first_seen(df, F.col("head"), F.col("doc_id")).select("doc_id", "source")


HTML = "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@register("html_text", f"SELECT page_id, sha256({HTML}) AS digest, length({HTML}) AS n FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.squash(T.strip_html(T.unescape(F.col("html"))))
    return read(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("long").alias("n"))


@register("pii_counts")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.pii_counts(F.col("text")).items()])


@register("redact_text")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@register("source_audit")
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_audit(read(spark, sf_dir, "documents"), "text", ["source"])


@register("split_counters", """SELECT 'lang' AS counter, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def split_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counters(read(spark, sf_dir, "documents"), ["lang", "source"])


@register("vector_topk", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id, round(list_inner_product(q.v, v.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(v.v, v.v))), 12) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, vec_id, round(s, 5) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 5""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.top_k(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 5))


@register("upsert_latest", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey % 2, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    version = F.struct("o_orderdate", F.col("o_orderkey") % 2, "o_orderkey")
    return retrieval.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", version).select("o_custkey", "o_orderkey")


@register("anti_ingest", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.only_new(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id")


@register("document_vectors", "SELECT doc_id, lang, label FROM documents JOIN embeddings ON vec_id = doc_id")
def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")


STOP = "('" + "', '".join(T.STOP_WORDS) + "')"


@register("tfidf_pair", f"""WITH f AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOP}) AS f FROM documents),
t AS (SELECT pair, side, unnest(list_concat(f, list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1]))) AS t FROM f),
c AS (SELECT pair, t, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM t GROUP BY 1, 2),
w AS (SELECT pair, a * i AS a, b * i AS b FROM (SELECT *, ln(3.0 / (1 + (a > 0)::INT + (b > 0)::INT)) + 1 AS i FROM c)),
s AS (SELECT pair, sum(a * b) / nullif(sqrt(sum(a * a) * sum(b * b)), 0) AS s FROM w GROUP BY 1)
SELECT pair, round(coalesce(s, 0.0), 5) AS similarity FROM (SELECT DISTINCT doc_id // 2 AS pair FROM documents) LEFT JOIN s USING (pair)""")
def tfidf_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select(F.expr("doc_id DIV 2").alias("pair"), (F.col("doc_id") % 2).alias("side"), "text").repartition("pair")
    return retrieval.tfidf_cosine(df.select("pair", "side", T.terms(F.col("text")).alias("t")), "pair", "side", "t").withColumn("similarity", F.round("similarity", 5))


@register("snippets", "SELECT doc_id, substr(text, 1, 40) || ' [source: ' || source || ']' AS snippet, concat_ws(',', lang, 'corpus') AS tags, 'evidence:' || substr(sha256(text), 1, 16) AS evidence_id FROM documents")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reply shows of a document, its tags with one added, and its evidence id. The first 40 characters are the feature."""
    df = read(spark, sf_dir, "documents")
    tags = F.concat(F.array("lang"), F.array(F.lit("corpus")))
    return df.select("doc_id", F.concat(F.substring("text", 1, 40), F.lit(" [source: "), "source", F.lit("]")).alias("snippet"), F.array_join(tags, ",").alias("tags"), hashing.evidence_id(F.col("text")).alias("evidence_id"))


@register("long_enough", "SELECT source, count(*) FILTER (WHERE length(text) >= 400) AS kept, count(*) FILTER (WHERE length(text) < 400) AS dropped, round(100.0 * count(*) FILTER (WHERE length(text) >= 400) / count(*), 4) AS share FROM documents GROUP BY 1")
def long_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.length("text") >= 400
    out = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(long).alias("kept"), F.count_if(~long).alias("dropped"))
    return out.withColumn("share", F.round(100.0 * F.col("kept") / (F.col("kept") + F.col("dropped")), 4))
