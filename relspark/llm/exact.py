"""Exact top-k search: tiles of queries and shards, each a matrix product, and lists merged as a tree.

Rows are packed where they lie into shards of SHARD vectors, queries into blocks of BLOCK. Every block meets every shard
(rows of thousands of vectors, not single ones); a tile is one exact matrix product of whole numbers, of which each
query keeps its k best by a partial selection. A task merges the lists of all its shards, so that it returns k rows for
each query; lists of up to FAN tasks are then merged at a time until each query has one.

Blocks are sent to the shards, which don't move: GROUP bytes of queries at most are broadcast at a time, so a search of more
queries takes more passes over the shards, whose cost is small beside the products that such a pass computes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import exact_products, finite, small_batches, whole_numbers, written

SCALE = 1024
#: Vectors of a shard and of a block; bytes of blocks broadcast at a time; lists merged at a time.
SHARD, BLOCK, GROUP, FAN = 8192, 1024, 64 << 20, 64
#: Query rows of a tile that are multiplied at a time.
STRIP = 256
#: No key (sorts after all others), and the score of an empty place.
NO_KEY, EMPTY = 2**63 - 1, -(2**63 - 1)

SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def best(q: np.ndarray, q_keys: np.ndarray, c: np.ndarray, c_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and keys (queries, k) of the best rows of c, whose keys ascend; ties to the smaller key, EMPTY where rows lack."""
    width, k_here = min(q.shape[1], c.shape[1]), min(k, len(c))
    scores, keys = np.full((len(q), k), EMPTY), np.full((len(q), k), NO_KEY)
    for at in range(0, len(q) if k_here else 0, STRIP):
        rows = slice(at, at + STRIP)
        s = exact_products(q[rows, :width], c[:, :width])
        s[q_keys[rows, None] == c_keys[None, :]] = EMPTY
        least = np.partition(s, len(c) - k_here, axis=1)[:, len(c) - k_here]
        taken, level = s > least[:, None], s == least[:, None]
        room = k_here - taken.sum(axis=1)
        tied = np.flatnonzero(level.sum(axis=1) > room)
        level[tied] &= np.cumsum(level[tied], axis=1) <= room[tied, None]
        _, j = np.nonzero(taken | level)
        j = j.reshape(-1, k_here)
        scores[rows, :k_here], keys[rows, :k_here] = np.take_along_axis(s, j, 1), c_keys[j]
    return scores, keys


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of each query."""
    s, keys = (np.concatenate(x, axis=1) for x in zip(a, b, strict=True))
    order = np.lexsort((keys, -s), axis=-1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(keys, order, 1)


def pack(rows: DataFrame, size: int, width: int, scale: float, limit: int) -> DataFrame:
    """(task, number, keys, x): up to `size` vectors of a partition in each row, ascending by key."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at, task = [], 0, 0, 0
        for b in (*batches, None):
            if b is not None and len(b):
                task = b.column(0)[0].as_py()
                held.append((b.column(1).fill_null(NO_KEY).to_numpy(), whole_numbers(b.column(2), width, scale, limit)))
                n += len(b)
            if n >= size or (b is None and n):
                keys, x = (np.concatenate(a) for a in zip(*held, strict=True))
                order = np.argsort(keys, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([at], pa.int64()), pa.array([keys[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())], names=["task", "number", "keys", "x"])
                held, n, at = [], 0, at + 1

    return rows.select(F.spark_partition_id().alias("task"), "k", "v").mapInArrow(packed, "task int, number long, keys binary, x binary")


def top_k(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, key, score): for each row of queries the k rows of vectors with the greatest inner product of floor(scale * x).

    A row with the query's own key is no candidate. Ties go to the smaller key; rows without one rank last among equals (a
    key of 2 ** 63 - 1 is read as none). All rows if there are fewer than k. Repeated rows are candidates each, repeated queries
    have a list each. Vectors that are null or hold null or non-finite components take no part on either side; shorter vectors
    count as filled with zeros, empty ones score 0. Whole components are held to what 64-bit products allow (2 ** 28 for 64 of
    them). Empty tables give no rows. Other columns are ignored. Keys are longs.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    spread = lambda df: df.where(finite(F.col(vector))).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    rows, asked = spread(vectors), written(spread(queries), "queries")
    n, longest = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, longest or 1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    limit = min(2**31 - 1, math.isqrt(2**62 // width))
    blocks = written(pack(asked.repartition(max(1, -(-n // BLOCK)), "k"), BLOCK, width, scale, limit), "blocks")
    passes = max(1, -(-n * (8 + 4 * width) // GROUP))
    shards = pack(rows, SHARD, width, scale, limit).select(F.col("task").alias("t"), F.col("keys").alias("c_keys"), F.col("x").alias("c"))
    shards = written(shards, "shards") if passes > 1 else shards

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int], tuple] = {}
        task, last, c, c_keys = 0, None, None, None
        matrix = lambda data: np.frombuffer(data, np.int32).reshape(-1, width)
        for b in batches:
            for t, keys, x, q_task, q_number, q_keys, q in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if keys != last:
                    last, c, c_keys = keys, matrix(x), np.frombuffer(keys, np.int64)
                task, at = t, (q_task, q_number)
                q_keys = np.frombuffer(q_keys, np.int64)
                found = best(matrix(q), q_keys, c, c_keys, k)
                lists[at] = (q_keys, *(merge(lists[at][1:], found, k) if at in lists else found))
        for (q_task, q_number), (q_keys, scores, keys) in lists.items():
            i, j = np.nonzero(scores != EMPTY)
            places = (np.int64(q_task) << 40) + (q_number << 20) + i
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), task, np.int32)), pa.array(places), pa.array(q_keys[i]), pa.array(scores[i, j]), pa.array(keys[i, j], mask=keys[i, j] == NO_KEY)], names=["task", "place", "query_id", "score", "k"])

    def one_pass(g: int) -> DataFrame:
        some = blocks.where(F.pmod(F.hash("task", "number"), F.lit(passes)) == g) if passes > 1 else blocks
        tiles = shards.crossJoin(F.broadcast(some))
        return written(tiles.mapInArrow(search, "task int, place long, query_id long, score long, k long"), "lists")

    lists = reduce(DataFrame.unionByName, [one_pass(g) for g in range(passes)])
    first = Window.partitionBy("place", "task").orderBy(F.desc("score"), F.col("k").asc_nulls_last())
    left = (lists.agg(F.max("task")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN)
        lists = lists.withColumn("task", F.expr(f"task div {FAN}")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("rank")
    return lists.withColumn("rank", F.row_number().over(first)).select("query_id", "rank", F.col("k").alias(key if key != "query_id" else "candidate_id"), "score")
