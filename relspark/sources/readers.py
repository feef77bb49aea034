"""Readers with declared schemas, and the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from relspark.functions import text as T


def records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines or CSV by suffix. JSON lines need a schema and fail on a line that is no object; CSV columns are text,
    with quoted line ends, and a byte order mark is dropped.
    """
    if path.endswith((".jsonl", ".json", ".ndjson")):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def first_of(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of several columns that is there and not empty."""
    found = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, *([default] if default is not None else []), F.lit(None).cast("string"))


#: Names under which sources give the same thing.
ALIASES = {"source_id": ["source_id", "questionID", "id"], "question": ["question", "questionText"], "answer": ["answer", "answerText"], "topic": ["topic", "topics"]}


def source_records(df: DataFrame, source: str, licence: str, order: str) -> DataFrame:
    """(source_id, question, answer, topic, source, license) of a table with any of the aliases.

    A missing id is the row's place by `order`; its k-th repetition becomes id:answer-k.
    """
    place = (F.row_number().over(Window.orderBy(order)) - 1).cast("string") if not any(n in df.columns for n in ALIASES["source_id"]) else F.col(order).cast("string")
    out = df.select(first_of(df, ALIASES["source_id"], place).alias("_id"), F.col(order).alias("_o"), *[first_of(df, ALIASES[n], F.lit(d)).alias(n) for n, d in (("question", ""), ("answer", ""), ("topic", "general"))])
    k = F.row_number().over(Window.partitionBy("_id").orderBy("_o"))
    out = out.withColumn("_k", k).withColumn("source_id", F.when(F.col("_k") > 1, F.concat("_id", F.lit(":answer-"), "_k")).otherwise(F.col("_id")))
    return out.select("source_id", "question", "answer", "topic", F.lit(source).alias("source"), F.lit(licence).alias("license"))


SUBJECT = "id array<string>, label array<int>, features array<array<double>>"


def subject_rows(spark: SparkSession, path: str, width: int = 12) -> DataFrame:
    """(subject, place, label, y, features) of files with parallel arrays, one a subject, named by it.

    y is 1 for label 2. Rows of another width or with values that aren't finite fail the query.
    """
    raw = spark.read.schema(SUBJECT).option("multiLine", True).json(path).withColumn("subject", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", ""))
    rows = raw.select("subject", F.posexplode(F.arrays_zip("label", "features")).alias("place", "x")).select("subject", "place", "x.label", "x.features")
    good = (F.size("features") == width) & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("bad features of "), "subject")).cast("array<double>"))
    return rows.select("subject", "place", "label", (F.col("label") == 2).cast("int").alias("y"), checked.alias("features"))


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, content) of all .md and .txt files below a folder, blank ones left out; ids are hashes of the paths."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(F.regexp_like("content", F.lit(r"\S")))
    return df.select(F.sha2("path", 256).alias("id"), "path", "content")


def signal_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """A column of numbers from a CSV file, empty cells left out; a missing column is an error."""
    df = spark.read.option("header", True).csv(path)
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).cast("double").alias("value"))


def require(df: DataFrame, columns: list[str], source: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{source} lacks {', '.join(missing)}")
    return df


def task_labels(df: DataFrame, task: str = "task", label: str = "binary_stress") -> DataFrame:
    """df with subject (the task up to its first underscore) and label 2 for 1, else 1."""
    return df.withColumns({"subject": F.split_part(F.col(task), F.lit("_"), F.lit(1)), "label": F.when(F.col(label).cast("int") == 1, 2).otherwise(1)})


def number(c: Column) -> Column:
    """Text as a number; empty and unreadable text is null."""
    return F.nullif(c, F.lit("")).try_cast("double")


def feature_array(df: DataFrame, names: list[str], field: str = "features") -> Column:
    """Features from one JSON or array column, else from a column each."""
    if field in df.columns:
        return F.from_json(field, "array<double>") if isinstance(df.schema[field].dataType, StringType) else F.col(field).cast("array<double>")
    return F.array(*[number(F.col(n)) for n in names])


def prediction(df: DataFrame) -> DataFrame:
    """df with probability and logit as numbers; a row must have exactly one, else both are null."""
    p = number(F.col("raw_probability").cast("string")) if "raw_probability" in df.columns else F.lit(None).cast("double")
    x = number(F.col("raw_logit").cast("string")) if "raw_logit" in df.columns else F.lit(None).cast("double")
    one = p.isNull() != x.isNull()
    return df.withColumns({"probability": F.when(one, p), "logit": F.when(one, x)})


def question_pages(df: DataFrame, question: str = "question", answer: str = "answer", least: int = 20) -> DataFrame:
    """(name, page): a Markdown page of each row whose cleaned texts are long enough, first questions only."""
    clean = lambda c: T.squash(T.normal_form(T.strip_html(F.coalesce(F.col(c), F.lit("")), "")))
    rows = df.select(clean(question).alias("q"), clean(answer).alias("a")).where((F.length("q") >= least) & (F.length("a") >= least))
    rows = rows.groupBy(F.substring(F.lower("q"), 1, 100).alias("k")).agg(F.min(F.struct("q", "a")).alias("r")).select("r.*")
    return rows.select(F.concat(T.slug(F.col("q")), F.lit(".md")).alias("name"), F.concat(F.lit("# "), "q", F.lit("\n\n"), "a", F.lit("\n")).alias("page"))
