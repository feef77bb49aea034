"""Ranks, running sums and order statistics of groups that no task holds.

Rows are dealt into ranges of (group, order) by sampling, so a group of any size is spread over ranges and a range holds
parts of few groups. Sums of a range's part of a group, a few rows for each range, give what comes before it; inside it a
window counts. Orders must tell rows apart (or values be summed first), or equal ones stay in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import few, written


def same(by: list[str], other: dict[str, str]) -> Column:
    """Null-safe equality of columns with those of the other side, named by `other`."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(other[c])) for c in by], F.lit(True))


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _part, from a table in the shared folder: later reads see the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a running sum for each name, this row included, and _all_<name>, the group's sum."""
    dealt = in_ranges(df.withColumns({f"_s_{n}": c for n, c in sums.items()}), [*map(F.col, by), *order])
    other = {c: f"_by{i}" for i, c in enumerate(by)}
    parts = dealt.groupBy("_part", *by).agg(*[F.sum(f"_s_{n}").alias(n) for n in sums])
    group = Window.partitionBy(*by)
    before = [(F.sum(n).over(group.orderBy("_part")) - F.col(n)).alias(f"_b_{n}") for n in sums]
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(o) for c, o in other.items()], *before, *[F.sum(n).over(group).alias(f"_all_{n}") for n in sums])
    out = dealt.join(parts, (F.col("_part") == F.col("_p")) & same(by, other))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.sum(f"_s_{n}").over(inside) + F.col(f"_b_{n}") for n in sums})
    return out.select(*df.columns, *sums, *[f"_all_{n}" for n in sums])


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "_i", size: str = "_n") -> DataFrame:
    """df with each row's number in its group, from 1, and the group's rows."""
    return running(df, by, order, {name: F.lit(1).cast("long")}).withColumnRenamed(f"_all_{name}", size)


def cells(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., _v, _c, _part) in ranges: each value of a group and how many rows have it."""
    found = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return in_ranges(found, [*map(F.col, by), F.col("_v")])


def distances(dealt: DataFrame, by: list[str], centers: DataFrame, center: str) -> DataFrame:
    """Cells of the distances from a group's center (by..., center), of cells. Rows aren't read again, nor brought together by group.

    Few values have one distance, so that equal ones needn't be summed.
    """
    off = dealt.join(few(centers), by).select(*by, F.abs(F.col("_v") - F.col(center)).alias("_v"), "_c")
    return in_ranges(off, [*map(F.col, by), F.col("_v")])


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """(by..., n, names...): for each name the value of a rank from 1, of a group's n rows that have a value. Ranks may use n.

    Equal values are summed first. Only ranges that hold a wanted rank are looked into.
    """
    return ranked(cells(df, value, by), by, ranks)


def ranked(dealt: DataFrame, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """order_statistics of cells."""
    other = {c: f"_by{i}" for i, c in enumerate(by)}
    parts = dealt.groupBy("_part", *by).agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*by)
    parts = parts.withColumns({"n": F.sum("_t").over(group), "_before": F.sum("_t").over(group.orderBy("_part")) - F.col("_t")})
    wanted = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(o) for c, o in other.items()], "n", "_before", "_t", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("_w"))
    wanted = wanted.where((F.col("_w.rank") > F.col("_before")) & (F.col("_w.rank") <= F.col("_before") + F.col("_t")))
    rows = dealt.join(wanted, (F.col("_part") == F.col("_p")) & same(by, other))
    inside = Window.partitionBy("_part", *by, "_w.name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_c").over(inside)
    found = rows.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_w.rank")) & (F.col("_upto") - F.col("_c") < F.col("_w.rank")))
    return found.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_w.name") == k, F.col("_v"))).alias(k) for k in ranks])


def quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by..., n, names...): quantiles by linear interpolation between neighbouring ranks."""
    return cell_quantiles(cells(df, value, by), by, shares)


def cell_quantiles(dealt: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """quantiles of cells."""
    place = {k: (F.col("n") - 1) * F.lit(float(q)) for k, q in shares.items()}
    ranks = {f"_{side}_{k}": f(p) + 1 for k, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = ranked(dealt, by, ranks)
    low, high = (lambda k: F.col(f"_lo_{k}")), (lambda k: F.col(f"_hi_{k}"))
    return found.select(*by, "n", *[(low(k) + (high(k) - low(k)) * (p - F.floor(p))).alias(k) for k, p in place.items()])


def melted(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """(keep..., column, value): a row for each named column of each row."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("_m")).select(*keep, "_m.column", "_m.value")


def column_quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """(by..., <column>_<share>...): quantiles of several columns, a row for each group."""
    long = quantiles(melted(df, by, columns), "value", [*by, "column"], shares)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}_{s}") for c in columns for s in shares])


def level(sizes: DataFrame, name: str, size: str, target: int) -> DataFrame:
    """(name, size, take): as even a share of `target` as sizes allow; what is left over goes to the largest, of equals the first by name.

    Poured over bins, `target` rises to the greatest whole level at which the sum of min(size, level) doesn't exceed it. With sizes
    in ascending order, min(size, level) sums to at most what comes before a bin plus level times the bins from it on, with equality
    for one bin, so the level is the greatest that any bin allows. A row for each bin; empty bins take none. Raises if there are more bins than `target`.
    """
    every = Window.partitionBy()
    rising = every.orderBy(size, name)
    full = sizes.select(name, F.col(size).cast("long").alias(size)).where(F.col(size) > 0)
    full = full.withColumns({"_m": F.count("*").over(every), "_k": F.row_number().over(rising) - 1, "_before": F.sum(size).over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size), "_all": F.sum(size).over(every)})
    full = full.withColumn("_level", F.max(F.floor((F.lit(target) - F.col("_before")) / (F.col("_m") - F.col("_k")))).over(every))
    full = full.withColumn("_level", F.when(F.col("_all") <= target, F.col("_all")).when(F.col("_m") > target, F.raise_error(F.lit("fewer wanted than bins")).cast("long")).otherwise(F.col("_level")))
    full = full.withColumn("take", F.least(F.col(size), F.col("_level")))
    full = full.withColumn("_left", F.greatest(F.lit(target) - F.sum("take").over(every), F.lit(0)))
    more = F.row_number().over(every.orderBy(F.desc(F.col(size) - F.col("take")), F.desc(size), name)) <= F.col("_left")
    full = full.withColumn("take", F.col("take") + (more & (F.col("take") < F.col(size))).cast("long"))
    return full.select(name, size, "take").unionByName(sizes.where(F.coalesce(F.col(size), F.lit(0)) <= 0).select(name, F.lit(0).cast("long").alias(size), F.lit(0).cast("long").alias("take")))
