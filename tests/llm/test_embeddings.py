import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import embeddings as E


def slow(rows, cosine):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i in range(len(good))}, {k: k for k, _ in good}
    pairs = [(i, j) for i in range(len(good)) for j in range(i) if len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] / np.sqrt((good[i][1] @ good[i][1]) * (good[j][1] @ good[j][1])) >= cosine]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    for _ in good:
        for i, j in pairs:
            a, b = good[i][0], good[j][0]
            label[a] = label[b] = min(label[a], label[b])
    out = [(k, links[i], label[k], k == label[k]) for i, (k, _) in enumerate(good)]
    rest = [(k, 0, k, True) for k, v in rows if not any(k == g and v == list(x) for g, x in good)]
    return sorted(out + rest, key=str)


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(60):
        base = rng.normal(size=16)
        for c in range(rng.integers(1, 6)):
            rows.append((100 * g + c, [float(np.float32(x)) for x in base + rng.normal(size=16) * 0.05 * c]))
    rows += [(9000, rows[0][1]), (9001, [2 * x for x in rows[0][1]]), (9002, None), (9003, []), (9004, [0.0] * 16), (9005, [1.0, None] * 8), (9006, [float("nan")] * 16), (9007, [float("inf")] * 16), (9008, rows[0][1][:8]), (9009, rows[0][1][:8])]
    return rows


@pytest.mark.parametrize("cell,block", [(512, 2048), (16, 2048), (16, 8)])
def test_same_links_as_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, n int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    want = slow(rows, 0.95)
    assert len(got) == len(want)
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_recall_and_edges(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = (x @ x.T >= 0.95).sum() - len(x)
    got = E.near_duplicates(df).agg(F.sum("n_links"), F.count("*")).first()
    assert got[1] == len(x) and 0.98 * want <= got[0] <= want
    two = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.n_links, r.component_id, r.kept) for r in E.near_duplicates(two).collect() if r.vec_id) == [(1, 1, True)] * 2
    assert E.near_duplicates(df.where("false")).count() == 0


def test_planted_pairs_in_a_larger_table(spark):
    """Recall against brute force over 3000 vectors, of which 800 have a partner at a cosine of 0.95 to 0.96, in several tables of cells."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 1600, 2):
        side = rng.normal(size=32)
        side -= (side @ x[i]) * x[i]
        c = rng.uniform(0.95, 0.96)
        x[i + 1] = c * x[i] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    lines, tables = E.plan(len(x))
    assert lines > 0 and tables > 1
    want = {i: set() for i in range(len(x))}
    for i, j in zip(*np.nonzero(np.triu((x @ x.T) / np.outer(*[np.sqrt((x * x).sum(axis=1))] * 2) >= 0.95, 1)), strict=True):
        want[i].add(j)
        want[j].add(i)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    n = sum(map(len, want.values()))
    assert n >= 1590 and sum(got[i].n_links for i in want) >= 0.99 * n
    assert all(got[i].n_links <= len(w) for i, w in want.items())
    assert all(got[i].component_id == min(i, *w) for i, w in want.items() if got[i].n_links == len(w) == 1 and all(len(want[j]) == 1 for j in w))


def test_counts_are_calibrated():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    _, counted = E.directions(32, 0, 1)
    found = {(i, j) for i, j in zip(*(np.concatenate(x) for x in zip(*E.candidates(a, b, counted, 0.95), strict=True)), strict=True)}
    assert sum((i, i) in found for i in range(4000)) >= 0.995 * 4000
    assert len(found) < 4400
