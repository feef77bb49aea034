import random

import numpy as np
import pytest
import xxhash

from relspark.llm import simhash
from pyspark.sql import functions as F

from relspark.llm.common import connected_components


def slow(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints_match_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a B c", "a b c d", "É x y \x1f z"] + [" ".join(rng.choice("ab cd efg É".split()) for _ in range(n)) for n in (4, 5, 9, 300)]
    assert [simhash.fingerprint(t and t.encode())[0] for t in texts] == [slow(t) for t in texts]


@pytest.mark.parametrize("words,radius", [(1, 4), (1, 0), (4, 50), (2, 31)])
def test_groups_give_the_components_of_near_pairs(words, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, words), dtype=np.uint64)
    fps, group = [], []
    for g, size in enumerate((1, 2, 63, 64, 65, 150, 40)):
        for _ in range(size):
            f = [int(x) for x in base[rng.integers(6)]]
            for k in rng.choice(64 * words, min(64 * words, int(rng.integers(0, 2 * radius + 2))), replace=False):
                f[k >> 6] ^= 1 << int(k & 63)
            fps.append(f)
            group.append(g)
    arr, group, rep = np.array(fps, dtype=np.uint64), np.array(group), np.arange(len(fps)) + 100
    side = np.where(group == 6, rng.integers(1, 3, len(group)), 0)

    def parts(pairs):
        f = simhash.Forest()
        for a, b in pairs:
            f.join(a, b)
        return [f.root(int(r)) for r in rep]

    far = lambda i, j: sum((a ^ b).bit_count() for a, b in zip(fps[i], fps[j], strict=True))
    want = [(int(rep[i]), int(rep[j])) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and (side[i] != side[j] or not side[i]) and far(i, j) <= radius]
    got = [e for part in simhash.edges_of_groups(group, side, arr, rep, radius) for e in zip(*part, strict=True)]
    assert parts(got) == parts(want)
    assert len(got) <= len(fps)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(5, 3), (3, 5), (7, 7), (9, 3), (200, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 5: 3, 9: 3, 200: 3}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    docs, word = {}, lambda: "".join(rng.choice("abcdef") for _ in range(4))
    for g in range(12):
        base = [word() for _ in range(150)]
        for c in range(6):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(len(w))] = word()
            docs[g * 10 + c] = " ".join(w)
    docs |= {500: None, 501: "", 502: "  ", 503: "same", 504: "same", 505: "x " * 20000}
    df = spark.createDataFrame([(k, v, "z") for k, v in docs.items()], "doc_id long, text string, fp string")
    want = components({k: slow(v) for k, v in docs.items()})
    for hot in (4096, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
        assert got == want
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_null_and_repeated_keys(spark):
    long = lambda n, at=0: " ".join(f"w{i + at}" for i in range(n))
    rows = [(None, long(90)), (7, long(90)), (3, long(90)), (3, long(60, 500)), (None, long(70, 900)), (None, long(70, 900)), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"k": 5, "similarity": 0.8}):
        got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df, **how).collect()]
        assert sorted(got, key=str) == sorted([(None, 3), (7, 3), (3, 3), (3, 3), (None, None), (None, None), (9, 9)], key=str)
    left = simhash.representatives(df.withColumn("row", F.lit("own"))).collect()
    assert sorted(((r.doc_id, r.text, r.row) for r in left), key=str) == sorted([(3, long(90), "own"), (3, long(60, 500), "own"), (None, long(70, 900), "own"), (9, None, "own")], key=str)


def test_similar_sets_are_linked(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, pairs = [], []
    for g in range(150):
        w = [word() for _ in range(300)]
        docs.append((2 * g, " ".join(w)))
        for at in range(0, 300, 60):  # five words changed: 25 of about 296 shingles
            w[at + 10] = word()
        docs.append((2 * g + 1, " ".join(w)))
        pairs.append((2 * g, 2 * g + 1))
    docs += [(1000 + i, " ".join(word() for _ in range(40))) for i in range(200)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, k=5, similarity=0.8).collect()}
    assert len(got) == len(docs)
    assert sum(got[a] == got[b] == a for a, b in pairs) >= 147
    assert all(got[1000 + i] == 1000 + i for i in range(200)) and got[2001] == 2000


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_only_pairs_of_the_exact_similarity_are_linked(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, n = {}, 0
    for family in range(60):  # a shared beginning and ends of their own: similarities from 0.55 to 0.85
        base = [word() for _ in range(200)]
        for member in range(4):
            docs[n] = " ".join(base + [word() for _ in range(20 + family + member)])
            n += 1
    for _ in range(10):  # chains of links, and texts near a hub but not near each other
        w = [word() for _ in range(200)]
        for member in range(6):
            docs[n] = " ".join(w)
            n += 1
            at = 30 * member
            w[at : at + 12] = [word() for _ in range(12)]
        hub = [word() for _ in range(200)]
        for member in range(6):
            docs[n] = " ".join(hub[:-15] + [word() for _ in range(15 if member else 0)] + (hub[-15:] if not member else []))
            n += 1
    pairs = [(a, b, jaccard(docs[a], docs[b])) for a in docs for b in range(a) if len(set(docs[a].split()) & set(docs[b].split())) > 60]
    assert sum(0.6 <= j < 0.8 for *_, j in pairs) > 100 and sum(0.8 <= j < 0.83 for *_, j in pairs) > 20
    forest = simhash.Forest()
    for a, b, j in pairs:
        if j >= 0.8:
            forest.join(a, b)
    want = {d: forest.root(d) for d in docs}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for hot in (4096, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, k=5, similarity=0.8).collect()}
        assert got == want
