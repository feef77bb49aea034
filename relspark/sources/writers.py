"""Writers: partitioned JSON, CSV with fixed places, releases behind a gate, envelopes with a checksum."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines with keys in alphabetical order on the top level and nulls written out."""
    out = df.select(*sorted(df.columns)).write.option("ignoreNullFields", False).mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).json(path)


def csv(df: DataFrame, path: str, places: dict[str, int] | None = None) -> None:
    """CSV with a header; the columns named in places get that many decimals. Quotes are doubled and white space stays, so that
    records() gives the same texts back, empty ones as null."""
    out = df.withColumns({c: F.format_string(f"%.{n}f", c) for c, n in (places or {}).items()}).write
    out.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).mode("overwrite").csv(path)


def canonical(payload: Any) -> str:
    return json.dumps(payload, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def envelope(payload: Any, schema: str) -> dict:
    """A payload with its schema's name and the SHA-256 of its canonical JSON."""
    return {"schema_version": schema, "payload": payload, "sha256": hashlib.sha256(canonical(payload).encode()).hexdigest()}


def open_envelope(document: dict, schema: str) -> Any:
    """The payload; raises if the schema differs or the checksum fails."""
    if document.get("schema_version") != schema:
        raise ValueError(f"expected {schema}")
    if hashlib.sha256(canonical(document["payload"]).encode()).hexdigest() != document.get("sha256"):
        raise ValueError("the checksum fails")
    return document["payload"]


def write_json(path: str, payload: Any) -> None:
    """One small document on the driver, by a temporary file and a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(payload, f, sort_keys=True, ensure_ascii=False, indent=2)
    os.replace(name, path)


def release(df: DataFrame, issues: DataFrame, path: str, split: str = "split") -> dict:
    """Writes df by split unless there are issues (code, message), and returns counts by split."""
    found = [tuple(r) for r in issues.limit(20).collect()]  # for the message only
    if found:
        raise ValueError(f"not released: {found}")
    df.write.partitionBy(split).mode("overwrite").json(path)
    return {r[0]: r[1] for r in df.groupBy(split).count().collect()}


def split_issues(df: DataFrame, split: str, group: str, fingerprint: str, required: list[str]) -> DataFrame:
    """(code, message): missing splits, and groups or fingerprints that lie in several."""
    spark = df.sparkSession
    need = spark.createDataFrame([(r,) for r in required], f"{split} string")
    missing = need.join(df.select(split).distinct(), split, "left_anti").select(F.lit("SPLIT_MISSING").alias("code"), F.col(split).alias("message"))
    over = lambda c, code: df.groupBy(c).agg(F.count_distinct(split).alias("n")).where("n > 1").select(F.lit(code).alias("code"), F.col(c).cast("string").alias("message"))
    return missing.unionByName(over(group, "GROUP_LEAKAGE")).unionByName(over(fingerprint, "DUPLICATE_LEAKAGE"))


def uri(path: str) -> str:
    """A path as a URI, for what tasks write on their own."""
    return path if ":/" in path else f"file://{os.path.abspath(path)}"


def pages(df: DataFrame, folder: str, name: str = "name", page: str = "page") -> None:
    """A text file for each row, written by the tasks that hold the rows, by a temporary name and a rename."""

    def put(rows) -> None:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        for r in rows:
            with where.open_output_stream(f"{path}/.{r[name]}.part") as f:
                f.write(r[page].encode())
            where.move(f"{path}/.{r[name]}.part", f"{path}/{r[name]}")

    df.select(name, page).foreachPartition(put)
