"""Signal features against slow forms."""

import duckdb
import numpy as np
import pytest

from relspark import catalog
from relspark.operators import signals as S
from relspark.plans import signals as plans


def triangle(v):
    """Kernel density and triangular fit, one place at a time."""
    n, h = len(v), v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), n)
    y = np.array([np.mean(np.exp(-0.5 * ((g - v) / h) ** 2)) / (h * np.sqrt(2 * np.pi)) for g in grid])
    p, best = int(np.argmax(y)), {}
    for f in range(n):
        if f != p:
            part = range(f if f < p else p, (p if f < p else f) + 1)
            inside = range(p + 1) if f < p else range(p, n)
            line = {i: y[p] * (i - f) / (p - f) if i in part else 0.0 for i in inside}
            e = [(y[i] - line[i]) ** 2 for i in inside]
            best[f] = np.sqrt(sum(((a + b) / 2) ** 2 for a, b in zip(e, e[1:], strict=False)))
    left, right = min((f for f in best if f < p), key=best.get), min((f for f in best if f > p), key=best.get)
    return grid[right] - grid[left], n / y[p]


def test_pulse_features_against_slow_forms(spark):
    rng = np.random.default_rng(3)
    good = [np.round(rng.uniform(0.5, 1.2, n) * 700) / 700 for n in (5, 20, 20, 64)]  # multiples of 1/700: differences of exactly 35/700 occur
    bad = [None, [], [0.8, 0.9], [0.8, 0.0, 0.9], [0.8, None, 0.9], [0.8, float("nan"), 0.9], [0.8] * 9]
    df = spark.createDataFrame([(i, None if v is None else list(map(lambda x: None if x is None else float(x), v))) for i, v in enumerate([*good, *bad])], "id int, beats array<double>")
    got = {r.id: r for r in S.pulse_features(df, "beats").collect()}
    for i, v in enumerate(good):
        near = max(1, sum(abs(a - b) > 0.05 for a in v for b in v))
        wave = 2 / len(v) * np.abs(np.fft.fft(v - v.mean()))[: len(v) // 2]
        freq = np.fft.fftfreq(len(v), v.mean())[: len(v) // 2]
        tinn, index = triangle(v)
        want = [np.mean(1 / v), np.std(1 / v), tinn, index, near, near / len(v) ** 2, v.mean(), v.std(), np.sqrt(np.mean(v * v)), freq.mean(), freq.std(), wave.sum()]
        assert [got[i][c] for c in S.PULSE] == pytest.approx(want, rel=1e-9) and got[i].problem is None
    for i in range(len(bad)):
        r = got[len(good) + i]
        assert all(r[c] is None for c in S.PULSE) and r.problem == ("TOO_LITTLE_VARIATION" if i == 6 else "TOO_FEW_INTERVALS")
    assert S.pulse_features(df.where("false"), "beats").count() == 0


def test_resampling_is_the_direct_convolution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=257)
    for up, down in ((3, 2), (2, 3), (7, 1), (1, 4), (25, 16)):
        most = max(up, down)
        k = np.arange(-10 * most, 10 * most + 1)
        h = np.sinc(k / most) * np.kaiser(len(k), 5.0)
        h *= up / h.sum()
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        want = np.convolve(wide, h)[10 * most :][: len(wide)][::down]
        assert S.resample(x, up, down) == pytest.approx(want, abs=1e-10)
        df = spark.createDataFrame([(s, i, float(v)) for s in "ab" for i, v in enumerate(x)], "s string, i long, v double")
        got = S.resampled(df, ["s"], "i", "v", down * 10, up * 10, size=40).orderBy("s", "i").collect()
        assert [r.i for r in got] == [*range(len(want))] * 2
        assert [r.v for r in got] == pytest.approx([*want, *want], abs=1e-10)


def test_resampling_gaps_and_edges(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 200, 2.0), ("a", 201, None), ("b", -3, 5.0), ("c", None, 5.0), ("d", 0, 3.0)], "s string, i long, v double")
    x = np.zeros(202)
    x[[0, 200]] = 1, 2
    got = {(r.s, r.i): r.v for r in S.resampled(df, ["s"], "i", "v", 2, 3, size=16).collect()}
    assert sorted({s for s, _ in got}) == ["a", "d"] and len([k for k in got if k[0] == "a"]) == 303
    assert [got["a", i] for i in range(303)] == pytest.approx(S.resample(x, 3, 2), abs=1e-12)
    assert S.resampled(df, ["s"], "i", "v", 5, 5).count() == 4 and S.resampled(df.where("false"), ["s"], "i", "v", 2, 3).count() == 0


def slow_peaks(x, threshold):
    z = (x - x.mean()) / x.std()
    s = np.convolve(z, np.full(5, 0.2), mode="same")
    runs, now = [], []
    for i, v in enumerate(s):
        if v < s.mean():
            runs, now = [*runs, now], []
        elif v > s.mean():
            now.append(i)
    return [int(max(r, key=lambda i: (s[i], -i))) for r in [*runs, now] if r and max(s[i] for i in r) > threshold]


def test_peaks_in_chunks_are_those_of_the_whole(spark):
    rng = np.random.default_rng(6)
    x = {"a": np.sin(np.arange(500) / 9) + rng.normal(size=500) * 0.2, "b": rng.normal(size=64), "flat": np.ones(10)}
    df = spark.createDataFrame([(s, i, float(v)) for s, vs in x.items() for i, v in enumerate(vs)] + [("a", None, 1.0), ("a", 500, None)], "s string, i long, v double")
    for size in (1 << 16, 50, 7):
        got = [(r.s, r.peak) for r in S.peaks(df, ["s"], "i", "v", 0.3, size=size).collect()]
        assert sorted(got) == [("a", p) for p in slow_peaks(x["a"], 0.3)] + [("b", p) for p in slow_peaks(x["b"], 0.3)]


def test_peaks_go_by_rows_not_by_gaps(spark):
    """As in SQL's frame of rows: gaps between positions don't count, a row without a value adds nothing."""
    rng = np.random.default_rng(8)
    x = np.sin(np.arange(300) / 7) + rng.normal(size=300) * 0.2
    at = np.cumsum(rng.integers(1, 4, 300)) * 1000 - 50_000  # negative positions, too
    df = spark.createDataFrame([("a", int(p), float(v)) for p, v in zip(at, x, strict=True)], "s string, i long, v double")
    for size in (1 << 16, 50):
        assert sorted(r.peak for r in S.peaks(df, ["s"], "i", "v", 0.3, size=size).collect()) == [at[p] for p in slow_peaks(x, 0.3)]
    held = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 9.0, None, None, None, None, None, None, 9.0, 0.0, 0.0, 0.0])], "s string, i long, v double")
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (0, 0.0), (1, 9.0), (2, NULL), (3, NULL), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, 9.0), (9, 0.0), (10, 0.0), (11, 0.0)) AS t(event_id, value)")
    got = [(r.peak, pytest.approx(r.height, abs=1e-6)) for r in S.peaks(held, ["s"], "i", "v", 0.3).collect()]
    assert sorted(got) == sorted(con.execute(catalog.oracle_sql()["signal_peaks"]).fetchall())


def test_equal_heights_of_a_run_are_the_first_place(spark):
    """Equal sums of decimals, which rounding would tell apart: as in whole numbers."""
    c = np.random.default_rng(10).integers(0, 30, 3000)
    s = np.convolve(c, np.full(5, 1), mode="same")
    runs = np.cumsum(s * len(s) < s.sum())
    top = {r: np.flatnonzero((runs == r) & (s * len(s) > s.sum())) for r in np.unique(runs)}
    want = [int(i[np.argmax(s[i])]) for i in top.values() if len(i) and s[i].max() / 5 - c.mean() > 0.3 * c.std()]
    for parts, by in ((1, 100), (7, 100), (3, 1e-6)):
        df = spark.createDataFrame([("a", i, float(v / by)) for i, v in enumerate(c.tolist())], "s string, i long, v double").repartition(parts)
        assert sorted(r.peak for r in S.peaks(df, ["s"], "i", "v", 0.3).collect()) == want


def test_pulse_means_halfway_between_roundings_are_those_of_sql(spark, tmp_path):
    """Means of values of few decimals lie halfway between two roundings, so that the order of the sum decides."""
    rng = np.random.default_rng(9)
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT range AS event_id, TIMESTAMP '2024-01-01' + to_minutes(range::INT % 20) AS ts, range // 20 AS user_id, 0.0::DOUBLE AS value FROM range(4000)")
    con.executemany("UPDATE events SET value = ? WHERE event_id = ?", [(round(float(v), 2), i) for i, v in enumerate(rng.exponential(50, 4000))])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert con.execute(f"SELECT count(*) FROM ({plans.PULSE_SQL})").fetchone()[0] == 200
    want = con.execute(f"SELECT user_id, rr_mean, tinn FROM ({plans.PULSE_SQL}) ORDER BY 1").fetchall()
    got = plans.pulse_features(spark, str(tmp_path)).select("user_id", "rr_mean", "tinn").orderBy("user_id").collect()
    assert [tuple(r) for r in got] == [pytest.approx(w, abs=1e-9) for w in want]
