"""Vector search, latest-wins upsert, ingest of what is new, and text similarity of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 512, parts: int = 16) -> DataFrame:
    """(query, key, similarity, rank): the k rows nearest to each query by cosine, itself excluded, ties by key.

    Queries and rows meet in blocks: queries are dealt into blocks by a hash, rows into parts, and each (block, part)
    keeps its own k best of every query before they are merged. A zero norm or a missing vector has similarity 0.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    q = queries.select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    v = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def unit(vs: pd.Series, width: int) -> np.ndarray:
        x = np.zeros((len(vs), width))
        for i, row in enumerate(vs):
            if row is not None:
                x[i, : len(row)] = np.nan_to_num(np.asarray(row, float))
        norm = np.sqrt((x * x).sum(axis=1))
        return x / np.where(norm > 0, norm, 1.0)[:, None]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max([len(x) for x in [*left["v"], *right["v"]] if x is not None], default=0)
        if left.empty or right.empty or not width:
            return pd.DataFrame({"q": [], "k": [], "s": []})
        right = right.sort_values("k")
        a, b, ids = unit(left["v"], width), unit(right["v"], width), right["k"].to_numpy()
        s = np.round(a @ b.T, 12)
        s[left["q"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"q": np.repeat(left["q"].to_numpy(), order.shape[1]), "k": ids[order.ravel()], "s": np.take_along_axis(s, order, 1).ravel()})
        return out[np.isfinite(out["s"])]

    found = q.groupBy("b", "p").cogroup(v.groupBy("b", "p")).applyInPandas(best, "q long, k long, s double")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "k")  # at most k rows of each part
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias("query"), F.col("k").alias(key), F.col("s").alias("similarity"), "rank")


def upsert(old: DataFrame, new: DataFrame, key: str, version: Column) -> DataFrame:
    """Rows of both by key, the latest version winning; new ones win ties. One aggregate, no sort of a key's rows."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*old.columns), F.struct(version, "_new")).alias("_r"))
    return latest.select("_r.*")


def only_new(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def cosines(lists: pa.ListArray) -> np.ndarray:
    """Cosine of smoothed tf-idf of two documents for each list of (side, hashes of terms), 0 where either has no terms."""
    out, parts = np.zeros(len(lists)), lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    terms = parts.field("h")
    n = terms.value_lengths().to_numpy(zero_copy_only=False)
    x, row, side = terms.flatten().to_numpy(zero_copy_only=False), np.repeat(row, n), np.repeat(parts.field("side").to_numpy(zero_copy_only=False), n)
    if not len(x):
        return out
    order = np.lexsort((x, row))
    x, row, side = x[order], row[order], side[order]
    start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (row[1:] != row[:-1])])
    a, b, row = np.add.reduceat((side == 0).astype(float), start), np.add.reduceat((side == 1).astype(float), start), row[start]
    idf = np.log(3.0 / (1 + (a > 0) + (b > 0))) + 1
    a, b = a * idf, b * idf
    ab, aa, bb = (np.bincount(row, v, len(lists)) for v in (a * b, a * a, b * b))
    norm = np.sqrt(aa * bb)
    return np.divide(ab, norm, out=out, where=norm > 0)


def tfidf_cosine(df: DataFrame, pair: str, side: str, terms: str) -> DataFrame:
    """(pair, similarity): cosine of smoothed tf-idf of two term lists, each pair a corpus of its own; 0 without terms.

    idf = ln((1 + 2) / (1 + documents with the term)) + 1, counts unscaled, vectors of length 1. Terms are equal by 64-bit hashes. A pair's
    lists meet in one row; if df is partitioned by pair before terms are taken from texts, only texts are moved.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cosines(b.column(1)))], names=[pair, "similarity"])

    sides = F.when(F.col(side) == 0, 0).when(F.col(side) == 1, 1).otherwise(2)
    hashes = F.coalesce(F.transform(terms, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))
    rows = df.groupBy(pair).agg(F.collect_list(F.struct(sides.alias("side"), hashes.alias("h"))).alias("_l"))
    return rows.mapInArrow(similar, f"`{pair}` {dict(df.dtypes)[pair]}, similarity double")
