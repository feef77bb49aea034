"""Expressions on SHA-256, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """Hex SHA-256 of the parts joined by colons. Strings are literals."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def bucket(group: Column, seed: str | int = 5101, buckets: int = 100) -> Column:
    """Bucket of a group from the first eight hex digits of its seeded digest."""
    return F.conv(F.substring(digest(str(seed), group), 1, 8), 16, 10).cast("long") % buckets


def split_name(group: Column, seed: str | int = 5101) -> Column:
    """80 : 10 : 10, all rows of a group on one side."""
    b = bucket(group, seed)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def subject_hash(subject: Column) -> Column:
    return F.sha2(subject.cast("string"), 256)


def evidence_id(content: Column) -> Column:
    return F.concat(F.lit("evidence:"), F.substring(F.sha2(content, 256), 1, 16))
