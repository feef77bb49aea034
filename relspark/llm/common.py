"""Helpers shared by the operators: batch sizes, cells dealt into blocks, and what the library has for all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.operators.graph import connected_components
from relspark.operators.storage import new_folder, shared_dir, written

__all__ = ["cell_blocks", "connected_components", "exact_products", "finite", "new_folder", "partitions", "ranges", "shared_dir", "small_batches", "table", "whole_numbers", "written"]

#: Most rows of (cell, blocks) that are broadcast, some megabytes.
BROADCAST_CELLS = 100_000
#: Bytes of the tables read for each range, and the size that the planner gives to tables that it knows nothing about.
RANGE_BYTES, UNKNOWN_BYTES = 128 << 20, 1 << 60
#: Bytes that separate words: space and TAB, LF, VT, FF, CR. bytes.split() splits at exactly these.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that long texts don't fill a worker.

    The settings hold when a lazy result runs, so they stay in the session; all operators ask for the same ones.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame) -> int:
    """Ranges to deal a table's texts into: as many as the session's partitions, more where the files read are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = partitions(df.sparkSession)
    return least if size >= UNKNOWN_BYTES else max(least, size // RANGE_BYTES)


def cell_blocks(rows: DataFrame, identity: list[str], most: int) -> DataFrame:
    """rows with i, j, side: within a cell, what has the same (i, j) is compared, side 1 with side 2, or side 0 with itself.

    A cell of up to `most` rows is one group. A larger one is dealt into blocks by a hash of the identity columns, and
    each row goes to the groups of its block with every block: all pairs of the cell meet in exactly one group.
    """
    kept = rows.columns
    hot = rows.groupBy("cell").count().where(F.col("count") > most).select("cell", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    hot = written(hot, "hot")
    n = hot.count()
    if not n:  # no join: the rows are shuffled once
        return rows.select("cell", *[F.lit(0).alias(c) for c in ("i", "j", "side")], *[c for c in kept if c != "cell"]).repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")
    rows = rows.join(F.broadcast(hot) if n <= BROADCAST_CELLS else hot, "cell", "left")
    own = F.pmod(F.xxhash64(*identity, F.lit(1)), F.col("blocks")).cast("int")
    other = F.expr("transform(sequence(0, blocks - 1), j -> struct(least(own, j) AS i, greatest(own, j) AS j, IF(own = j, 0, IF(own < j, 1, 2)) AS side))")
    alone = F.expr("array(struct(0 AS i, 0 AS j, 0 AS side))")
    rows = rows.withColumn("own", own).select(*kept, F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(other)).alias("p"))
    rows = rows.select("cell", "p.i", "p.j", "p.side", *[c for c in kept if c != "cell"])
    return rows.repartition(partitions(rows.sparkSession), "cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_numbers(lists: pa.ListArray, width: int, scale: float, limit: int) -> np.ndarray:
    """floor(scale * x) of each vector's components in double precision, held to +-limit; (vectors, width), zeros after a vector's end."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -limit, limit)
    out = np.zeros((len(lists), width), np.int32)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: in doubles where every sum is exact there, else in 64-bit integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
