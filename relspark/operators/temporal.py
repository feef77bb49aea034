"""Decisions over time, by session: k of m, hysteresis, cooldown, order, bound versions.

All windows of a session share one partitioning and one order, so Spark deals and sorts the rows once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def k_of_m(p: Column, session: str | list[str], seq: str, on: float, m: int) -> Column:
    """How many of the last m rows of the session, this one included, reach `on`."""
    w = Window.partitionBy(session).orderBy(seq)
    return F.sum((p >= on).cast("int")).over(w.rowsBetween(1 - m, 0))


def states(df: DataFrame, session: str | list[str] = "session", seq: str = "seq", p: str = "p", on: float = 0.65, off: float = 0.45, k: int = 2, m: int = 3) -> DataFrame:
    """df with elevated (count of m), active and state.

    A session becomes active when a row reaches `on` and k of its last m rows did; it stays so until a row is at most
    `off`. Active rows are ELEVATED; others MONITOR above `off`, else LOW. Rows are taken in the order of seq.
    """
    w = Window.partitionBy(session).orderBy(seq)
    out = df.withColumn("elevated", k_of_m(F.col(p), session, seq, on, m))
    event = F.when((F.col(p) >= on) & (F.col("elevated") >= k), F.lit(True)).when(F.col(p) <= off, F.lit(False))
    out = out.withColumn("active", F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    return out.withColumn("state", F.when(F.col("active"), "ELEVATED").when(F.col(p) > off, "MONITOR").otherwise("LOW"))


def out_of_order(session: str | list[str], seq: str, ts: str) -> Column:
    """Whether a row's time lies before an earlier row's of its session. Equal times are in order."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.col(ts) < F.max(ts).over(w), F.lit(False))


def bound_version(session: str, seq: str, version: str, accepted: Column) -> Column:
    """First version of the session that an accepted row before this one had."""
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.first(F.when(accepted, F.col(version)), ignorenulls=True).over(w)


def notifications(df: DataFrame, session: str, seq: str, ts: str, active: str, cooldown_seconds: float) -> DataFrame:
    """Active rows that notify: the first of a session, then each at least the cooldown after the last that did.

    What is kept depends on what was kept before, which no window frame expresses. Active rows are dealt by session
    and sorted, and one pass with a single time as state reads them in batches: a session's length doesn't matter.
    """
    step = int(cooldown_seconds * 1_000_000)
    rows = df.where(F.col(active)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.repartition(session).sortWithinPartitions(session, seq)

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for b in batches:
            keep = []
            for s, us in zip(b[session].tolist(), b["_us"].tolist(), strict=True):
                if s != now:
                    now, last, take = s, us, True
                elif take := us - last >= step:
                    last = us
                keep.append(take)
            yield b[keep].drop(columns="_us")

    return rows.mapInPandas(greedy, df.schema)
