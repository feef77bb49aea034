"""Ranks and order statistics in ranges, levels, and selection."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.operators import fit, prepare, ranks


def test_quantiles_and_numbers_of_hot_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": np.round(rng.normal(size=700), 1), "one": np.array([4.0]), "ties": np.full(50, 2.0)}
    df = spark.createDataFrame([(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [("hot", 9999, None)], "g string, i long, v double")
    got = {r.g: r for r in ranks.quantiles(df, "v", ["g"], {"q1": 0.01, "mid": 0.5, "q9": 0.9}).collect()}
    for g, vs in groups.items():
        assert [got[g].n, got[g].q1, got[g].mid, got[g].q9] == pytest.approx([len(vs), *np.quantile(vs, [0.01, 0.5, 0.9])])
    rows = ranks.numbered(df.where("v IS NOT NULL"), ["g"], [F.desc("v"), F.col("i")]).collect()
    for g, vs in groups.items():
        order = sorted(range(len(vs)), key=lambda i: (-vs[i], i))
        assert [r.i for r in sorted((r for r in rows if r.g == g), key=lambda r: r._i)] == order and {r._n for r in rows if r.g == g} == {len(vs)}
    assert ranks.quantiles(df.where("false"), "v", ["g"], {"m": 0.5}).count() == 0
    assert ranks.order_statistics(df, "v", [], {"least": F.lit(1), "most": F.col("n")}).first()[:] == (751, float(min(groups["hot"])), 4.0)


def test_profile_never_brings_a_groups_rows_together(spark, monkeypatch):
    """Deviations come from counted values that stay in their ranges: before, a task took a whole group's rows."""
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.normal(size=900), 2), "one": np.array([4.0]), "even": np.array([1.0, 2.0, 4.0, 9.0]), "ties": np.array([0.0] * 9 + [3.0] * 20 + [6.0] * 9)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), (None, 1.0)], "g string, v double")
    plans, deal = [], ranks.in_ranges
    monkeypatch.setattr(ranks, "in_ranges", lambda x, order: plans.append(x._jdf.queryExecution().executedPlan().toString()) or deal(x, order))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.g: (r.n, r.median, r.scale) for r in fit.robust_profile(df, "v", ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(g" not in plans[1] and "SortMergeJoin" not in plans[1]
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        mad = np.median(np.abs(vs - np.median(vs))) * 1.4826
        assert got[g] == pytest.approx((len(vs), np.median(vs), mad if mad > 1e-8 else np.std(vs, ddof=1) if len(vs) > 1 and np.std(vs, ddof=1) > 1e-8 else 1.0))


def poured(sizes, target):
    """One unit at a time to the bin that has the least, of equals the largest, then the first."""
    out = dict.fromkeys(sizes, 0)
    for _ in range(target):
        room = [b for b in sizes if out[b] < sizes[b]]
        if room:
            out[min(room, key=lambda b: (out[b], -sizes[b], b))] += 1
    return out


def test_level_is_what_pouring_gives(spark):
    rng = random.Random(7)
    for sizes, target in [({0: 5, 1: 0, 2: 2, 3: 9}, 8), ({0: 1, 1: 1}, 9), ({0: 3}, 2), *(({b: rng.randrange(12) for b in range(6)}, rng.randrange(6, 40)) for _ in range(4))]:
        df = spark.createDataFrame(list(sizes.items()), "b int, size long")
        assert {r.b: r["take"] for r in ranks.level(df, "b", "size", target).collect()} == poured(sizes, target)
    with pytest.raises(Exception, match="fewer wanted than bins"):
        ranks.level(spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "b int, size long"), "b", "size", 2).collect()


def test_subjects_are_chosen_over_bins(spark):
    df = spark.createDataFrame([(i, i * 0.01) for i in range(40)], "s long, r double")
    got = prepare.choose_subjects(df, "s", "r", 0.3, 5).collect()
    assert sorted(b for b in (r.bin for r in got if r.chosen)) == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 5] and [r.s for r in got if r.bin == 1 and r.s > 7] == []
    assert prepare.choose_subjects(df.where("s = 0"), "s", "r", 0.3, 5).first().chosen and prepare.choose_subjects(df.where("false"), "s", "r", 0.3, 5).count() == 0
    assert sum(r.chosen for r in prepare.choose_subjects(df.where("s < 3"), "s", "r", 1.0, 9).collect()) == 2


def test_baselines_fall_back_to_windows(spark):
    nan = math.nan
    whole = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", nan), ("c", "x", None)], "s string, f string, v double")
    windows = spark.createDataFrame([("a", "x", 9.0), ("b", "x", 3.0), ("b", "x", 5.0), ("b", "y", nan), ("b", "y", 4.0), ("d", "x", 7.0)], "s string, f string, v double")
    got = {(r.s, r.f): (r.v, r.origin) for r in prepare.robust_baseline(whole, windows, ["s"], "f", "v").collect()}
    assert got == {("a", "x"): (1.0, "whole"), ("a", "y"): (2.0, "whole"), ("b", "x"): (4.0, "windows"), ("b", "y"): (4.0, "windows"), ("c", "x"): (None, "none"), ("d", "x"): (7.0, "windows")}


def test_temperature_by_steps_agrees_with_the_grid(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000) * 3
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-x / 2.5))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)] + [(None, 1)], "x double, y int")
    t, loss = fit.temperature_steps(df, "y", "x")
    at = lambda t: np.mean(np.logaddexp(0, x / t) - y * x / t)
    grid = np.arange(1.0, 6.0, 0.001)
    best = min(grid, key=at)
    assert abs(t - best) < 2e-3 and loss == pytest.approx(at(t)) and loss <= at(best) + 1e-9
    assert math.isnan(fit.temperature_steps(df.where("false"), "y", "x")[1])
