import random
import zlib

import numpy as np
import pytest

from relspark.llm import toxicity as T


def test_windows_cover_every_word():
    for n in range(0, 200):
        s = T.starts(n)
        assert {i for a in s for i in range(a, min(n, a + T.WINDOW))} == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(s, s[1:], strict=False))


def test_passages_lie_whole_in_a_window():
    for n in range(17, 200):
        s = T.starts(n)
        assert all(any(a <= i and i + 17 <= a + T.WINDOW for a in s) for i in range(n - 16))


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = T.Network([np.concatenate(([0], rng.normal(size=9)))] * 2)
    word, gram = rng.integers(0, 10, (3, 5)), rng.integers(0, 10, (3, 5, 6))
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    word[~mask], gram[~mask], y = 0, 0, np.array([1, 0, 1])
    _, grad = net.gradients(word, gram, mask, y)
    for k, w in net.w.items():
        flat = w.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            if k in ("word", "gram") and i < T.DIMENSIONS:
                continue
            old, two = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = old + step
                two.append(net.gradients(word, gram, mask, y)[0])
            flat[i] = old
            assert abs((two[0] - two[1]) / 2e-5 - grad[k].reshape(-1)[i]) < 1e-6, k


def docs(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéfgh") for _ in range(rng.randrange(2, 7)))
    out = []
    for i in range(n):
        w, bad = [word() for _ in range(rng.randrange(3, 120))], i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Xenozz", "stupax"]) + rng.choice(["", "en", "ung", word()]) + rng.choice(["", "!"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_fast_scorer_matches_the_network():
    rows = docs(120)
    scorer = T.train([(str(k), t, y) for k, t, y in rows], 0.25, epochs=2)
    texts = [t.split() for _, t, _ in rows[:30]]
    net_logits = []
    net = T.train.__globals__["Network"](scorer.vocabulary.odds)
    one = T.Scorer(scorer.vocabulary, net, (1.0, 0.0), 0.0)
    for ws in texts:
        best = []
        for s in T.starts(len(ws)):
            part = [T.plain(w) for w in ws[s : s + T.WINDOW]]
            i, g = scorer.vocabulary.index(part)
            best.append(net.forward(net.inputs(i[None], g[None]), np.ones((1, len(part)), bool))[0][0])
        net_logits.append(max(best))
    assert np.allclose(one.logits(texts), net_logits, atol=1e-3)
    assert np.allclose(np.concatenate([one.logits([t]) for t in texts]), net_logits, atol=1e-3)


def test_held_out_accuracy_and_edges(spark):
    rows = docs(1500)
    odd = [(9000, None, "q"), (9001, "", "q"), (9002, " \n", "q"), (None, "some words", "q"), (3, rows[3][1], "q"), (9003, "stupaxen " * 5000, "q")]
    df = spark.createDataFrame([(k, t, "q") for k, t, _ in rows] + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(77777, 1), (5, None)], "doc_id long, toxic int")
    out = T.score(df, labels).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert {r.doc_id for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1500} == set(held)
    truth = {k: y for k, _, y in rows}
    assert np.mean([by[k].predicted == truth[k] for k in held]) > 0.93
    assert by[9003].predicted == 1 and by[9000].score == by[9001].score == by[9002].score == pytest.approx(0.25, abs=0.03)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in T.score(df, labels.where("false")).collect()} == {0.0}
    assert T.score(df.where("false"), labels).count() == 0


def test_sampled_texts_are_whole(spark):
    long = "clean words " * 15_000 + "Xenozz"
    rows = [(k, long if k == 11 else "short text", int(k == 11)) for k in range(10, 14)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    learnt = {str(k): (t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % T.FOLDS}
    assert "11" in learnt
    got = {r.k: (r.t, r.y) for r in T.sample(df, labels, "doc_id", "text", "toxic")[0].collect()}
    assert got == learnt
