"""Vector codes against plain Lloyd rounds in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from relspark.llm import codes


def lloyd(rows, parts, entries, rounds):
    """(key, code, error) and the codebooks, by full scans; rows: (key, whole components) in the order of seeds."""
    w = len(rows[0][1]) // parts
    cut = [[tuple(x[p * w : (p + 1) * w]) for p in range(parts)] for _, x in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda part, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(part, book[e], strict=True)), e))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(c[p], books[p]) for c in cut]
            for e in set(of):
                mine = [c[p] for c, k in zip(cut, of, strict=True) if k == e]
                books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    out = []
    for (k, _), c in zip(rows, cut, strict=True):
        at = [near(c[p], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{e:02x}" for e in at), sum(sum((a - b) ** 2 for a, b in zip(c[p], books[p][at[p]], strict=True)) for p in range(parts))))
    return out, books


def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], i % 4) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1], 1) for i in range(60)]  # copies: ties between entries
    rows += [(5, [round(x, 1) for x in rows[5][1]], None), (None, rows[9][1], None)]
    return rows


@pytest.mark.parametrize("entries,rounds", [(16, 4), (256, 2), (1000, 1)])
def test_same_codes_as_full_scans(spark, entries, rounds):
    rows = vectors()
    bad = [(2000, None, 1), (2001, [0.0] * 7 + [None], 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = codes.compress(df, entries=entries, rounds=rounds).collect()
    order = sorted(((k, x, y) for k, x, y in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, books = lloyd([(k, [math.floor(1024 * c) for c in x]) for k, x, _ in order], 4, entries, rounds)
    digits = (lambda c: c) if entries <= 256 else (lambda c: None)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted(((r.vec_id, r.code, r.error) for r in got), key=key)
    if digits("x"):
        assert found == sorted(want, key=key)
    else:
        assert [(r[0], r[2]) for r in found] == [(r[0], r[2]) for r in sorted(want, key=key)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    sums = {}
    for (_, _, y), (_, _, e) in zip(order, want, strict=True):
        sums[y] = sums.get(y, 0) + e
    assert sorted(r.label_error for r in got) == sorted(sums[y] for _, _, y in order)


def test_bounds_spare_scans_and_never_change_a_code():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-90, 90, size=(40, 4)) + c for c in rng.integers(-4000, 4000, size=(16, 4))])
    book = x[::40].copy()
    code, first, second = codes.scan(x, book)
    upper, lower = codes.above(np.sqrt(first)), codes.below(np.sqrt(second))
    scanned = []
    for _ in range(5):
        old, book = book, np.stack([x[code == e].sum(axis=0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(len(book))])
        scanned.append(codes.reassign(x, code, upper, lower, book, codes.Moves(old, book)))
        want, d, e = codes.scan(x, book)
        assert (code == want).all() and (upper >= np.sqrt(d)).all() and (lower <= np.sqrt(e)).all()
    assert sum(scanned) < len(x) // 4


def test_edges(spark):
    kind = "vec_id long, embedding array<float>, label string"
    assert codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, "a")], kind)).count() == 0
    one = codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "a"), (2, [], None), (2, [3e38] * 3, None)], kind)).orderBy("vec_id").collect()
    assert [(r.vec_id, r.error, r.label_error) for r in one] == [(1, 0, 0), (2, 0, 0), (2, 0, 0)]  # filled with zeros, held to the limit
