"""Lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from relspark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, n + 1, None if none else d, -s) for n, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n=400):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)] + ["ÉTÉ", "été", "ß", "日本", "A1", "a1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # copies: equal scores
    docs += [(7, docs[8][1]), (7, docs[8][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, " -;\x7f\n"), (2003, "w3 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)] + [(40, docs[7][1]), (41, "W0,w0;w0"), (42, None), (43, ""), (44, "unknown"), (41, "w1"), (None, "w149 été")]
    return docs, items


@pytest.mark.parametrize("block,shard,items_at_once,run", [(128, 1 << 22, 256, 64), (4, 900, 7, 3), (1, 60, 100, 1)])
def test_same_lists_as_scoring_everything(spark, monkeypatch, block, shard, items_at_once, run):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("ITEMS", items_at_once), ("RUN", run)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int").repartition(3)
    table, n_docs, n_terms = lexical.index(df)
    assert n_docs == sum(bool(terms(t)) for _, t in docs) and n_terms == sum(len(terms(t)) for _, t in docs)
    got = lexical.search(table, n_docs, spark.createDataFrame(items, "item_id long, text string"), k=6).collect()
    assert sorted(map(tuple, got), key=str) == slow(docs, items, 6)


def test_blocks_below_the_threshold_stay_compressed():
    """Two frequent terms of little weight, and two that only the first twentieth of the documents has."""
    rng = np.random.default_rng(2)
    n = 40_000
    has = rng.random((n, 4)) < np.array([0.9, 0.6, 0.4, 0.5])
    has[2000:, 2:] = False
    has[:, 0] |= ~has.any(axis=1)
    docs = [(np.flatnonzero(row), np.ones(row.sum(), np.int32)) for row in has]
    batches = list(lexical.shard_rows(0, np.arange(n), docs, [f"t{i}".encode() for i in range(4)], n, sum(int(t.sum()) for _, t in docs)))
    first, *rest = batches
    m = np.frombuffer(first.column(6)[0].as_py(), np.int64)
    rows = [r for b in rest for r in b.to_pylist()]
    lists = [(lexical.Postings(r["n"], r["last"], r["top"], r["at"], r["data"], m), w) for r, w in zip(rows, (1, 2, 40, 50), strict=True)]
    scores, found = lexical.search_shard(lists, n, 2, 1)
    total = np.zeros(n, np.int64)
    for i, (ids, tf) in enumerate(docs):
        total[i] = sum(lists[t][1] * int(lexical.impacts(f, m[i])) for t, f in zip(ids, tf.astype(np.int64), strict=True))
    order = np.lexsort((np.arange(n), -total))[:2]
    assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    blocks, opened = sum(len(p.last) for p, _ in lists), sum(len(p.open) for p, _ in lists)
    assert opened < blocks / 4, (opened, blocks)


def test_bytes_round_trip():
    rng = np.random.default_rng(3)
    values = np.concatenate((rng.integers(0, 2**34, 500), np.arange(300), [0, 127, 128, 16383, 16384]))
    data, starts = lexical.to_bytes(values)
    assert (lexical.from_bytes(data) == values).all() and starts[-1] == len(data) and (lexical.from_bytes(data[starts[3] : starts[9]]) == values[3:9]).all()
    assert len(lexical.from_bytes(data[:0])) == 0


def test_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id int, text string"
    table, n_docs, _ = lexical.index(spark.createDataFrame([], docs))
    assert n_docs == 0 and lexical.search(table, n_docs, spark.createDataFrame([(1, "a")], items)).count() == 0
    table, n_docs, _ = lexical.index(spark.createDataFrame([(1, "a b")], docs))
    assert lexical.search(table, n_docs, spark.createDataFrame([], items)).count() == 0
