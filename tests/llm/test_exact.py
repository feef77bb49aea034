"""Exact search against sorting all products."""

import math
import random

import numpy as np
import pytest

from relspark.llm import exact


def slow(rows, queries, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in [(i, [math.floor(1024 * x) for x in v]) for i, v in queries if v is not None and all(x is not None and math.isfinite(x) for x in v)]:
        scored = sorted((-sum(a * b for a, b in zip(v, c, strict=False)), i is None, i or 0) for i, c in whole if i is None or i != q)
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block,group,fan", [(8192, 1024, 64 << 20, 64), (16, 4, 200, 2), (1, 1, 1, 2)])
def test_same_lists_as_sorting_everything(spark, monkeypatch, shard, block, group, fan):
    for name, value in (("SHARD", shard), ("BLOCK", block), ("GROUP", group), ("FAN", fan)):
        monkeypatch.setattr(exact, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # a third of all rows are one vector: ties
    rows += [(3, rows[4][1]), (None, rows[3][1]), (None, rows[5][1]), (300, [0.5, 0.5]), (301, []), (302, None), (303, [0.0] * 5 + [None]), (304, [float("nan")] * 6)]
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 3] + [(300, rows[0][1])]
    if group == 1:
        queries = queries[:3]
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows, kind).repartition(5)
    got = exact.top_k(df, spark.createDataFrame(queries, kind), k=10).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows, queries, 10)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, query_id string"
    df = spark.createDataFrame([(100, [1.0, 2.0], "x"), (1, [1.0, -2.0], "y")], kind)
    assert [tuple(r) for r in exact.top_k(df, df.where("vec_id = 100")).collect()] == [(100, 1, 1, -3 * 1024 * 1024)]
    assert exact.top_k(df, df.where("false")).count() == 0 and exact.top_k(df.where("false"), df).count() == 0
    assert exact.top_k(df.where("vec_id = 1"), df.where("vec_id = 1")).count() == 0


def test_large_numbers_are_exact():
    rng = np.random.default_rng(4)
    q, c = (rng.integers(-(2**28), 2**28, size=(n, 6)) for n in (7, 50))
    scores, keys = exact.best(q, np.full(7, -1), c, np.arange(50), 5)
    for i in range(7):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[i], row, strict=True)), j) for j, row in enumerate(c))[:5]
        assert sorted((-int(s), int(k)) for s, k in zip(scores[i], keys[i], strict=True)) == want
