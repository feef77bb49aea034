"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that are broadcast for a join.
FEW = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where unset in local mode a temporary folder, which also becomes the checkpoint folder. On a cluster it must be set."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if not (path := sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="relspark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/relspark/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder: lost executors cost no recomputation beyond it."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """A table of ids, for a join: broadcast only if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df
