"""The opN_ queries: each applies its operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, embeddings, exact, lexical, lm, packing, quality, records, simhash, substring, toxicity, urls
from .common import new_folder, table


URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = quality.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = records.write(docs, vocabularies.path("word_bpe_49k.json"), new_folder(spark, "records"), end_id=2)
    return records.read(spark, files).select(F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, vocabularies.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.parse(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return out.select("doc_id", "n_words", F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("log_score", F.round("log_score", 4))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs, _ = lexical.index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, n_docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": urls.sql(URL_RULES),
        "op4_embedding_near_dedup": embeddings.SQL,
        "op5_quality_rules": quality.SQL,
        "op9_substring_dedup": substring.SQL,
        "op10_lm_scoring": lm.SQL,
        "op11_vector_codes": codes.sql(),
        "op12_exact_top_k": exact.SQL,
        "op13_lexical_search": lexical.SQL,
    }
