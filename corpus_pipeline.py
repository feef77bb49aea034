"""Quality rules, toxicity, SimHash near-dedup, substring dedup and packing, one after the other over documents.

Every stage takes all that the one before it kept. What the quality rules reject leaves in the first stage, toxic rows
leave in the second; of near duplicates (five-word shingles, a similarity of 0.8 or more) the row with the smallest doc_id
stays. A null doc_id is no reason to leave: such rows are judged like others, have no labels, and stay where no row with a
doc_id is near. Of rows with one doc_id each is a document of its own, and which of two near ones stays is told by their
texts. Repeated passages are cut out of the texts that stay, which are otherwise unchanged (a text may become empty); the
last stage packs all texts. Null and empty texts have no words and leave with the quality rules. Extra columns are kept up to the last stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import packing, quality, simhash, substring, toxicity
from relspark.llm.common import new_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs.withColumn("row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), table(spark, sf_dir, "labels").select("doc_id", "quality"), carry=["row"])
    return judged.where("kept").select("row.*")


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    scored = toxicity.annotate(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), name)
    return scored.where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, k=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    parsed = substring.parse(docs, carry=rest)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.col("kept"))
    out = parsed.withColumn("text", text)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    pieces = packing.pack(docs.select("doc_id", "text"), vocabularies.path("byte_bpe_50k.json"), length=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_texts),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", packed),
]
#: Learnt weights and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
