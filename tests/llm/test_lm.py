import math
import random
from collections import Counter

import duckdb
import pytest

from relspark.llm import lm


def slow(docs):
    split = [(k, (t or "").encode().split()) for k, t in docs]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    every = Counter()
    for _, w in split:
        every.update(grams(w))
    total, out = sum(len(w) for _, w in split), []
    for k, w in split:
        own, s, used = grams(w), 0.0, Counter()
        c = lambda *g: every[g] - own[g]
        for i, x in enumerate(w):
            if i > 1 and c(w[i - 2], w[i - 1], x):
                s, n = s + math.log(c(w[i - 2], w[i - 1], x) / c(w[i - 2], w[i - 1])), 3
            elif i and c(w[i - 1], x):
                s, n = s + math.log(c(w[i - 1], x) / c(w[i - 1])) + (i > 1) * math.log(0.4), 2
            else:
                s, n = s + math.log(max(c(x), 0.5) / max(total - len(w), 1)) + min(i, 2) * math.log(0.4), 1
            used[n] += 1
        out.append((k, len(w), used[3], used[2], round(s, 6)))
    return sorted(out)


@pytest.mark.parametrize("size", [8_000_000, 900])
def test_scores_match_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(lm, "BATCH_BYTES", size)
    monkeypatch.setattr(lm, "BUCKET_GRAMS", size)
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("a b c d e é f g".split()) for _ in range(rng.randrange(80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "only here"), (5, docs[5][1]), (103, "x " * 3000)]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, batch string")
    got = sorted((r.doc_id, r.n_words, r.n_trigrams, r.n_bigrams, round(r.log_score, 6)) for r in lm.score(df).collect())
    assert got == slow(docs)
    assert lm.score(df.where("false")).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' WHERE doc_id < 60")
    want = sorted(con.execute(lm.SQL).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    got = sorted((r.doc_id, r.n_words, r.n_trigrams, r.n_bigrams, round(r.log_score, 4)) for r in lm.score(docs).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-3 for g, w in zip(got, want, strict=True))


def test_words_of_hashes_near_each_other_have_their_own_counts(spark):
    docs = [(0, "w815044 a"), (1, "w2798805 b"), (2, "w622996 c"), (3, "w158630 d")]  # pairs that agree on 40 bits
    got = sorted((r.doc_id, r.n_words, r.n_trigrams, r.n_bigrams, round(r.log_score, 6)) for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == slow(docs)
