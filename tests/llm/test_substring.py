import random
from collections import Counter

import numpy as np
import pytest

from relspark.llm import substring


def slow(docs, window):
    split = {k: (t or "").encode().split() for k, t in docs}
    seen = Counter()
    for k, _ in docs:
        w = split[k]
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(3))
    line = lambda n: [word() for _ in range(n)]
    passages = [line(n) for n in (34, 35, 36, 50, 60, 90)]
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "same " * 400), (5, " ".join(line(34))), (6, "a b " * 60)]
    for i in range(10, 60):
        w = line(rng.randrange(5, 60))
        for _ in range(rng.randrange(4)):
            w += rng.choice(passages) + line(rng.randrange(0, 40))
        docs.append((i, (" " if i % 2 else "\n").join(w)))
    base = line(300)
    for i in range(100, 112):
        w = list(base)
        for _ in range(i - 100):
            w[rng.randrange(300)] = word()
        docs.append((i, " ".join(w)))
    docs += [(200, docs[20][1]), (201, " ".join(passages[5][:40])), (202, " ".join(passages[4][10:44]))]
    return docs


@pytest.mark.parametrize("window,gram,most", [(35, 12, 4096), (7, 3, 4096), (35, 12, 2), (7, 3, 1)])
def test_same_words_as_brute_force(spark, window, gram, most):
    docs = corpus()
    df = spark.createDataFrame([(k, t, 1, None) for k, t in docs], "doc_id long, text string, k int, at string")
    got = {}
    for r in substring.parse(df, window=window, gram=gram, most=most).collect():
        got[r.doc_id] = (r.n_words, sum(s["end"] - s["first"] for s in r.spans or []), r.kept)
    assert got == slow(docs, window)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    rows = substring.parse(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 40, ""), (1, 40, ""), (1, 40, "")]
    assert substring.parse(df.where("false")).count() == 0
    assert substring.parse(df.limit(1)).first().spans is None


def test_a_repeated_key_with_different_texts(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text + " end"), (1, "short one"), (None, "alone"), (2, "so " + text)], "doc_id long, text string")
    rows = substring.parse(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in rows) == [(0, 1, "alone"), (1, 2, "short one"), (1, 51, "end"), (2, 51, "so")]


def test_factors_of_a_block():
    words = [f"w{i}".encode() for i in range(60)]
    texts = [words, [*words[:50], b"x", *words[51:]], [b"y", *words[3:40], b"z", b"z"]]
    found = []
    for t in texts:
        anchors, _, place = substring.stretches(t)
        first, _, n = substring.unpacked(place)
        hashes = [substring.WORDS[w] for w in t]
        found.append([(a, p, np.array(hashes[f : f + c + 34], np.uint64).tobytes()) for a, p, f, c in zip(anchors.view(np.int64), place, first.tolist(), n.tolist(), strict=True)])
    rows = sorted(((a, p, w, n) for n, x in enumerate(found) for a, p, w in x), key=lambda r: int(r[0]))
    cols = [np.array([r[i] for r in rows]) for i in (0, 1)]
    row, start, end = substring.parse_block(*cols, np.ones(len(rows), bool), [r[2] for r in rows])
    assert (end - start >= 35).all()
    for n, t in enumerate(texts):
        other = {tuple(x[i : i + 35]) for m, x in enumerate(texts) if m != n for i in range(len(x) - 34)}
        want = {j for i in range(len(t) - 34) if tuple(t[i : i + 35]) in other for j in range(i, i + 35)}
        got = {j for r, a, b in zip(row, start, end, strict=True) if rows[r][3] == n for j in range(a, b)}
        assert got == want
