"""Rules and formulas on small rows with known results."""

import html
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.functions import numeric
from relspark.functions import text as T
from relspark.operators import cascade, dedup, dialogue, fit, graph, metrics, prepare, retrieval, stats, temporal
from relspark.sources import readers, writers


def test_redaction_and_counts(spark):
    texts = ["Email a.b@c.org or call +44 20 7946 0958; see https://x.org/y @someone", "<b>Tom &amp; Ann</b>\n\n www.site.net", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", T.redact(F.col("t")).alias("t"), *[c.alias(n) for n, c in T.pii_counts(F.col("t")).items()]).collect()}
    assert got[0].t == "Email [EMAIL] or call [PHONE]; see [URL] [HANDLE]"
    assert (got[0].email, got[0].url, got[0].phone, got[0].handle) == (1, 1, 1, 1)
    assert got[1].t == "Tom & Ann [URL]" and got[2].t == "" and got[3].t == ""
    assert html.unescape("Tom &amp; Ann") == "Tom & Ann"


def test_consent_and_rules(spark):
    cases = {"Yes.": "yes", "  OK ": "yes", "no   thanks!": "no", "Never mind": "cancel", "change it": "refine", "perhaps": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in df.select("t", T.consent(F.col("t")).alias("c")).collect()} == cases
    claims = {"You have a mental disorder": True, "I cannot diagnose this": False, "stop your medication": True, "I can't diagnose, but take your medication": True, "Rest well": False}
    df = spark.createDataFrame([(k,) for k in claims], "t string")
    assert {r.t: r.c for r in df.select("t", T.unsafe_claim(F.col("t")).alias("c")).collect()} == claims


def test_numbers(spark):
    r = spark.range(1).select(
        numeric.sigmoid(F.lit(-800.0)).alias("low"), numeric.sigmoid(F.lit(800.0)).alias("high"), numeric.logit(F.lit(0.0)).alias("zero"),
        numeric.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("none"), numeric.cosine(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0))).alias("short"),
        numeric.percent_change(F.lit(0.0), F.lit(1.0)).alias("na"), numeric.percent_change(F.lit(2.0), F.lit(3.0)).alias("up"), numeric.finite_or_null(F.lit("inf")).alias("inf"),
        T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("empty"),
    ).first()
    assert (r.low, r.high, r.none, r.short, r.na, r.up, r.inf, r.empty) == (0.0, 1.0, 0.0, 1.0, "N/A", "+50.00%", None, 1.0)
    assert r.zero == pytest.approx(math.log(1e-7) - math.log1p(-1e-7))


def fold(rows, on=0.65, off=0.45, k=2, m=3, cool=60.0):
    """The rules one row at a time."""
    flags, active, sent, out = [], False, None, []
    for p, t in rows:
        flags = (flags + [p >= on])[-m:]
        if p >= on and sum(flags) >= k:
            active = True
        elif p <= off:
            active = False
        notify = active and (sent is None or (t - sent).total_seconds() >= cool)
        sent = t if notify else sent
        out.append(("ELEVATED" if active else "MONITOR" if p > off else "LOW", notify))
    return out


def sessions():
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    out = {}
    for s in range(25):
        t = t0
        rows = []
        for _ in range(rng.randrange(1, 40)):
            rows.append((round(rng.random(), 2) * 0.99 + 0.003, t))
            t += timedelta(seconds=rng.randrange(0, 50))
        out[s] = rows
    return out


def test_temporal_rules_against_a_fold(spark):
    data = sessions()
    rows = [(s, i, p, t) for s, rs in data.items() for i, (p, t) in enumerate(rs)]
    df = spark.createDataFrame(rows, "session int, seq int, p double, ts timestamp")
    live = temporal.states(df)
    got = {(r.session, r.seq): r.state for r in live.collect()}
    sent = {(r.session, r.seq) for r in temporal.notifications(live, "session", "seq", "ts", "active", 60).collect()}
    for s, rs in data.items():
        for i, (state, notify) in enumerate(fold(rs)):
            assert got[s, i] == state and ((s, i) in sent) == notify
    assert temporal.notifications(live.where("false"), "session", "seq", "ts", "active", 60).count() == 0


def test_stream_equals_batch_and_reports_late_rows(spark, tmp_path):
    from relspark.streaming import sessions as stream

    data = sessions()
    rows = [(s * 1000 + i, s, "x", p * 20 / (1 - p), t) for s, rs in data.items() for i, (p, t) in enumerate(rs)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp")
    whole = df.coalesce(1)
    whole.write.parquet(f"{tmp_path}/whole")
    states = stream.session_states(stream.events_stream(spark, f"{tmp_path}/whole"), cooldown_seconds=60)
    q = states.writeStream.format("memory").queryName("states_out").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = {r.seq: (r.state, r.notify) for r in spark.table("states_out").collect()}
    for s, rs in data.items():
        for i, want in enumerate(fold(rs)):
            assert got[s * 1000 + i] == want
    late = spark.createDataFrame([(1, 1, 5, 0.9), (2, 1, 4, 0.9), (3, 1, 5, 0.9)], "seq long, session long, us long, p double")
    update = stream.updater(0.65, 0.45, 2, 3, 0, None)

    class State:
        hasTimedOut, exists, value = False, False, None

        def update(self, v):
            self.value = v

    out = list(update((1,), iter([late.toPandas()]), State()))[0]
    assert out["late"].tolist() == [False, True, False] and out["state"].tolist() == ["MONITOR", None, "ELEVATED"]


POLICY = cascade.Policy(medians=[0.0] * 3, scales=[1.0] * 3, centers=[0.0] * 3, spreads=[1.0] * 3, ood_threshold=6.0, conformal_quantile=0.4)


def test_cascade_gates_in_order(spark):
    zero, nan = [0.0] * 3, float("nan")
    cases = [
        (1, zero, 0.9, None, "2024-01-01T00:00:00Z", "model", None, None, None, []),
        (2, zero, 0.9, None, "no time", "model", None, None, "DATA_INVALID", ["TIMESTAMP_INVALID"]),
        (3, zero, 0.9, None, None, "other", None, None, "DATA_INVALID", ["MODEL_ID_MISMATCH"]),
        (4, [0.0], 0.9, None, None, "model", None, None, "DATA_INVALID", ["FEATURE_COUNT_INVALID"]),
        (5, [0.0, nan, 0.0], 0.9, None, None, "model", None, None, "DATA_INVALID", ["NONFINITE_FEATURE"]),
        (6, zero, 0.9, None, None, "model", 1.5, None, "DATA_INVALID", ["EXTERNAL_QUALITY_INVALID"]),
        (7, zero, 0.9, None, None, "model", 0.1, None, "DATA_INVALID", ["EXTERNAL_QUALITY_LOW"]),
        (8, zero, 0.9, None, None, "model", None, {"window_seconds": 10.0, "rpeak_success": 0.1}, "DATA_INVALID", ["SIGNAL_WINDOW_TOO_SHORT", "RPEAK_QUALITY_LOW"]),
        (9, [0.0, 100.0, 0.0], 0.9, None, None, "model", None, None, "DATA_INVALID", ["FEATURE_OUT_OF_RANGE"]),
        (10, zero, None, None, None, "model", None, None, "DATA_INVALID", ["PROBABILITY_INVALID"]),
        (11, zero, 0.9, 1.0, None, "model", None, None, "DATA_INVALID", ["PROBABILITY_INVALID"]),
        (12, [20.0, 20.0, 20.0], 0.9, None, None, "model", None, None, "OOD_OR_UNCERTAIN", ["QUALITY_OK", "OOD_HIGH"]),
        (13, zero, 0.55, None, None, "model", None, None, "OOD_OR_UNCERTAIN", ["QUALITY_OK", "IN_DOMAIN", "CONFORMAL_AMBIGUOUS", "CONFIDENCE_LOW"]),
        (14, zero, None, 3.0, None, "model", 0.9, {"window_seconds": 30.0}, None, []),
    ]
    df = spark.createDataFrame([c[:8] for c in cases], "seq int, features array<double>, probability double, logit double, ts_text string, model_id string, external_quality double, signal_quality map<string,double>")
    got = {r.seq: (r.state, r.reasons or []) for r in cascade.gates(df, POLICY).collect()}
    assert got == {c[0]: (c[8], c[9]) for c in cases}
    ts = df.where("seq IN (1, 14)").withColumns({"session": F.lit(1), "ts": F.when(F.col("seq") == 1, F.lit(datetime(2024, 1, 2))).otherwise(F.lit(datetime(2024, 1, 1)))})
    out = {r.seq: (r.state, r.reasons[-1], r.allowed_actions) for r in cascade.decide(ts, POLICY).collect()}
    assert out[14] == ("DATA_INVALID", "TIMESTAMP_OUT_OF_ORDER", "retry_sensor,continue_by_text") and out[1][0] == "MONITOR"


def test_fits_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.linspace(-3, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x - 0.5))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
    a, b = fit.platt(df, "y", "x")
    p = 1 / (1 + np.exp(-a * x - b))
    assert abs(((p - y) * x).sum() + 1e-4 * a) < 1e-5 and abs((p - y).sum()) < 1e-5
    t = fit.temperature(df, "y", "x")
    loss = lambda t: np.mean(np.logaddexp(0, x / t) - y * x / t)
    assert loss(t) <= min(loss(s) for s in np.exp(np.linspace(math.log(0.05), math.log(20), 4001))) + 1e-9
    v = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert fit.order_statistic(v, "v", fit.higher_quantile(0.99), []).first().v == 100.0
    med, scale = fit.profile_arrays(spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([4.0, 5.0],)], "f array<double>"), "f")
    assert med == [2.0, 5.0] and scale == [1.4826, 1.0]


def test_metrics_with_ties_and_missing_classes(spark):
    rng = random.Random(5)
    rows = [(g, round(rng.random(), 1), rng.randrange(2) if g else 1) for g in (0, 1, 2) for _ in range(60)]
    df = spark.createDataFrame(rows, "g int, p double, y int")
    got = {r.g: r.auroc for r in metrics.auroc(df, "y", "p", ["g"]).collect()}
    for g in (1, 2):
        pos, neg = [p for h, p, y in rows if h == g and y], [p for h, p, y in rows if h == g and not y]
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got[0] is None
    assert metrics.confusion(df.where("g = 0"), "y", F.lit(False), ["g"]).first().f1 == 0.0
    assert stats.student_p(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7) and stats.p_bucket(0.03) == "p < 0.05"


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i, [rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 14))]) for i in range(150)]
    docs += [(200 + i, docs[i][1][:-1]) for i in range(60)]
    sets = {i: frozenset(w) for i, w in docs}
    df = spark.createDataFrame(docs, "k long, s array<string>")
    reps, members = dedup.classes(df, "k", "s")
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    for t in (0.9, 0.6):
        got = {(r.a, r.b) for r in dedup.similar_pairs(reps, t).collect()}
        rep = sorted(set(first.values()))
        want = {(a, b) for a in rep for b in rep if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert got == want
    assert {r.k: r.rep for r in members.collect()} == {i: first[s] for i, s in sets.items()}
    assert graph.connected_components(spark.createDataFrame([(3, 2), (2, 1), (9, 8)], "a long, b long")).count() == 5


def test_verifier(spark):
    base = dict(user_text="I feel tense", response="I hear you. Would you like to rest?", target="SUPPORT", state="RELIABLE_LOW", awaiting=False, stressor=False, evidence={}, cited=[], tool=None, dry_run=None, needs_confirmation=None, tool_allowed=None, may_propose=False, uncertainty_acknowledged=False, brief=True, disallowed=[])
    cases = {
        "fine": ({}, []),
        "crisis": ({"user_text": "I want to kill myself"}, ["CRISIS_NOT_ESCALATED", "POLICY_TARGET_MISMATCH"]),
        "diagnosis": ({"response": "You have a mental disorder"}, ["DIAGNOSTIC_CLAIM"]),
        "unknown": ({"evidence": {"a": "rest well"}, "cited": ["b"]}, ["UNKNOWN_EVIDENCE_ID"]),
        "cited": ({"evidence": {"a": "hear rest"}, "cited": ["a"]}, []),
        "action": ({"tool": "book", "tool_allowed": True, "may_propose": False, "dry_run": True, "needs_confirmation": True}, ["ACTION_NOT_ALLOWED"]),
        "blocked": ({"response": "I hear you. Try cold showers", "disallowed": ["cold_showers"]}, ["DISALLOWED_INTERVENTION"]),
        "sure": ({"response": "I hear you. It will definitely pass"}, ["OVERCONFIDENT_LANGUAGE"]),
        "long": ({"response": "I hear you. " + "word " * 100}, ["RESPONSE_TOO_LONG"]),
        "unsure": ({"state": "DATA_INVALID", "target": "ASK"}, ["UNCERTAINTY_NOT_ACKNOWLEDGED"]),
    }
    schema = "name string, user_text string, response string, target string, state string, awaiting boolean, stressor boolean, evidence map<string,string>, cited array<string>, tool string, dry_run boolean, needs_confirmation boolean, tool_allowed boolean, may_propose boolean, uncertainty_acknowledged boolean, brief boolean, disallowed array<string>"
    df = spark.createDataFrame([{"name": n} | base | c for n, (c, _) in cases.items()], schema)
    got = {r.name: r for r in dialogue.verify(df).collect()}
    assert {n: got[n].reasons for n in cases} == {n: codes for n, (_, codes) in cases.items()}
    assert got["fine"].passed and got["fine"].overall == pytest.approx(1.0) and got["crisis"].reward == -1.0 and not got["crisis"].fixable and got["sure"].fixable


def test_top_k_upsert_and_first(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<double>")
    got = [(r["query"], r.id, r["rank"]) for r in retrieval.top_k(v, v.where("id = 1"), "id", "v", 3, block=1, parts=2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2), (1, 4, 3)]
    old, new = (spark.createDataFrame(r, "k int, n int, x string") for r in ([(1, 1, "a"), (2, 5, "b")], [(1, 1, "c"), (2, 4, "d"), (3, 0, "e")]))
    assert sorted(tuple(r) for r in retrieval.upsert(old, new, "k", F.col("n")).collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 0, "e")]


def test_windows_and_alignment(spark):
    df = spark.createDataFrame([(1, i, 2 if i < 6 else 1) for i in range(12)], "s int, i int, label int")
    assert [(r.start, r.label) for r in prepare.label_windows(df, "s", "i", "label", 3, 3).orderBy("start").collect()] == [(0, 2), (3, 2), (6, 1)]
    n = spark.range(1).select(F.size(prepare.signal_windows(F.sequence(F.lit(1), F.lit(10)).cast("array<double>"), 4, 3)).alias("n")).first().n
    assert n == 3
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 2)) @ [[2, 1], [0, 1]], rng.normal(size=(300, 2)) + 5
    da, db = (spark.createDataFrame([tuple(map(float, r)) for r in x], "p double, q double") for x in (a, b))
    moved = prepare.coral(da, ["p", "q"], prepare.moments(da, ["p", "q"]), prepare.moments(db, ["p", "q"]))
    m, c = prepare.moments(moved, ["p", "q"])
    assert np.allclose(m, b.mean(axis=0), atol=1e-6) and np.allclose(c, np.cov(b.T), atol=1e-3)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,questionText,answerText\n7,"Why,\nso?",Yes\n7,Who,\n,x,y\n', encoding="utf-8")
    df = readers.records(spark, f"{tmp_path}/a.csv").withColumn("row", F.monotonically_increasing_id())
    got = [tuple(r)[:4] for r in readers.source_records(df, "s", "cc", "row").orderBy("source_id").collect()]
    assert got == [("2", "x", "y", "general"), ("7", "Why,\nso?", "Yes", "general"), ("7:answer-2", "Who", "", "general")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "S2.json").write_text('{"id": ["a", "b"], "label": [2, 1], "features": [[1.0, 2.0], [3.0, 4.0]]}')
    assert [(r.subject, r.y) for r in readers.subject_rows(spark, f"{tmp_path}/s", 2).orderBy("place").collect()] == [("S2", 1), ("S2", 0)]
    with pytest.raises(Exception, match="bad features"):
        readers.subject_rows(spark, f"{tmp_path}/s", 3).collect()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.md").write_text("hello")
    (tmp_path / "t" / "y.txt").write_text(" \n")
    assert [r.content for r in readers.text_folder(spark, f"{tmp_path}/t").collect()] == ["hello"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\nnope\n')
    with pytest.raises(Exception):
        readers.records(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    doc = writers.envelope({"b": 1, "a": [1.5]}, "v1")
    assert writers.open_envelope(doc, "v1") == {"b": 1, "a": [1.5]}
    with pytest.raises(ValueError):
        writers.open_envelope(doc | {"payload": {}}, "v1")
    rows = spark.createDataFrame([("train", "g1", "f1"), ("test", "g1", "f2")], "split string, grp string, fp string")
    issues = writers.split_issues(rows, "split", "grp", "fp", ["train", "validation", "test"])
    assert sorted(r.code for r in issues.collect()) == ["GROUP_LEAKAGE", "SPLIT_MISSING"]
    with pytest.raises(ValueError):
        writers.release(rows, issues, f"{tmp_path}/out")
    assert writers.release(rows, issues.where("false"), f"{tmp_path}/out") == {"train": 1, "test": 1}
    pages = readers.question_pages(spark.createDataFrame([("<p>Why is the sky blue?</p>", "Because of <b>scattering</b> light")], "question string, answer string"))
    writers.pages(pages, f"file://{tmp_path}/pages")
    assert re.search("scattering", (tmp_path / "pages" / "why-is-the-sky-blue.md").read_text())
