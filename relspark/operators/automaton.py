"""Finite automata over ordered rows: the state before each row, by composing transition functions.

A run of rows is a function from the state before it to the state after it, an array with a state for each state. Functions
compose associatively, so rows are folded in blocks of SIZE positions, blocks in blocks of blocks, and so on, until a key
has one; then each block's first state goes down the levels again. A key of any length is many groups, none above SIZE rows
(times the rows that share a position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

SIZE = 64


def states_before(df: DataFrame, key: str, position: str, code: str, table: list[list[int]], start: int = 0, size: int = SIZE) -> DataFrame:
    """df with `before`: the automaton's state when it comes to the row.

    table[state][code] is the next state. Rows of a key are taken by position (whole numbers from 0), rows of one position by
    their code; each key begins at `start`. Rows without a position, or with a negative one, have no state and change none; a
    null code changes none. An empty table gives no rows.
    """
    moves = F.array(*[F.array(*map(F.lit, row)) for row in table])
    same = F.array(*map(F.lit, range(len(table))))
    good = F.col(position) >= 0
    rows = df.where(good).select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), F.col(position).cast("long").alias("_at"), F.col(code).cast("int").alias("_code"))
    step = lambda s, c: F.when(c.isNull(), s).otherwise(F.get(F.get(moves, s), c))

    def grouped(df: DataFrame, item: Column) -> DataFrame:
        return df.groupBy("_key", F.floor(F.col("_at") / size).alias("_at")).agg(F.sort_array(F.collect_list(item)).alias("_items"))

    levels = [written(grouped(rows, F.struct("_at", "_code", F.xxhash64(F.to_json("_row")).alias("_tie"), "_row")), "blocks")]
    composed = levels[0].select("_key", "_at", F.transform(same, lambda s: F.aggregate("_items", s, lambda a, r: step(a, r["_code"]))).alias("_f"))
    while (levels[-1].agg(F.max("_at")).first()[0] or 0) > 0:
        levels.append(written(grouped(composed, F.struct("_at", "_f")), "blocks"))
        composed = levels[-1].select("_key", "_at", F.aggregate("_items", same, lambda f, r: F.transform(f, lambda s: F.get(r["_f"], s))).alias("_f"))
    down = levels[-1].withColumn("_from", F.lit(start))
    for level in reversed(levels[:-1]):
        first = F.struct(F.col("_from").alias("s"), F.array().cast("array<struct<at:bigint,s:int>>").alias("out"))
        child = F.aggregate("_items", first, lambda a, r: F.struct(F.get(r["_f"], a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(r["_at"].alias("at"), a["s"].alias("s")))).alias("out")))
        starts = down.select("_key", F.explode(child["out"]).alias("_c")).select(F.col("_key").alias("_k"), F.col("_c.at").alias("_a"), F.col("_c.s").alias("_from"))
        down = level.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_a"))).drop("_k", "_a")
    first = F.struct(F.col("_from").alias("s"), F.array().cast("array<int>").alias("out"))
    before = F.aggregate("_items", first, lambda a, r: F.struct(step(a["s"], r["_code"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))
    pairs = down.select(F.explode(F.arrays_zip(F.col("_items._row").alias("r"), before["out"].alias("b"))).alias("_p"))
    out = pairs.select("_p.r.*", F.col("_p.b").alias("before"))
    return out.unionByName(df.where(~F.coalesce(good, F.lit(False))).withColumn("before", F.lit(None).cast("int")))
