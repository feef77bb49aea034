"""Audits and gates of text data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relspark.functions import text as T

from .metrics import count, safe


def source_audit(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """rows, empty ones, exact duplicates (rows less distinct fingerprints) and personal data found, by group."""
    pii = T.pii_counts(F.col(text))
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        count(blank).alias("empty"),
        (F.count("*") - F.count_distinct(T.fingerprint(T.normalized(F.col(text))))).alias("duplicates"),
        *[F.sum(c).alias(n) for n, c in pii.items()],
    )


def issues(checks: dict[str, Column]) -> Column:
    """Codes of what is wrong with a row, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in checks.items()]), lambda c: c.isNotNull())


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with their codes)."""
    marked = df.withColumn("issues", issues(checks))
    return marked.where(F.size("issues") == 0).drop("issues"), marked.where(F.size("issues") > 0)


def counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(counter, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.counter", "x.value").agg(F.count("*").alias("n"))


def completion_eval(df: DataFrame, parsed: Column, right: Column, violation: Column, reward: Column, words: Column, by: list[str]) -> DataFrame:
    """Shares and means over completions, and whether the gate (parse rate 0.99, no violation) is open."""
    share = lambda c: safe(count(c), F.count("*"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), share(parsed).alias("parse_rate"), share(right).alias("accuracy"), share(violation).alias("violation_rate"), F.avg(reward).alias("mean_reward"), F.avg(words).alias("mean_words"))
    return out.withColumn("gate", (F.col("parse_rate") >= 0.99) & (F.col("violation_rate") == 0))
