"""Product-quantised codes of vectors by Lloyd's rounds with Hamerly's bounds, in whole numbers.

Every vector is cut into PARTS consecutive parts; each part position has a codebook of its own. A table in the shared
folder persists for each part its entry, an upper bound of the distance to it and one lower bound of the distance to any
other entry. After a round the bounds give way by how far entries have moved. Only where the upper bound isn't strictly
below the lower one (nor below half the distance from the entry to its nearest neighbour), even after the distance to the
own entry is taken anew, all entries are scanned in whole numbers, the lowest index first; as a strict bound excludes
ties, codes are those of full scans. Bounds are doubles rounded away from certainty.

Each round reads and writes the table once, without a shuffle, and sums parts by entry inside each task, so a label or a
vector that a third of all rows share is like any other. The driver holds the codebooks (entries * width numbers).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_CELLS, exact_products, finite, small_batches, whole_numbers, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Relative margin of bounds, some hundred times what a few double operations may be off.
MARGIN = 2.0**-44


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after the other, each a join of parts and entries."""
    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS x FROM v, range({parts}) AS r(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, p, min(struct_pack(d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x), e := c.e)) AS best FROM p JOIN c{n} c USING (p) GROUP BY ALL)")
        if n < rounds:
            sums = f"SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, best.e AS e, unnest(range(len(x))) AS i, unnest(x) AS x FROM p JOIN a{n} USING (vec_id, p)) GROUP BY ALL"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(u.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS x FROM ({sums}) GROUP BY ALL) u USING (p, e))")
    return f"""WITH {", ".join(steps)},
f AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN v USING (vec_id), h"""


def squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) ** 2).sum(axis=-1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part, the lowest index of equals; squared distances to it and to the nearest other one."""
    d = squares(x)[:, None] - 2 * exact_products(x, book) + squares(book)[None, :]
    code, rows = d.argmin(axis=1), np.arange(len(x))
    first = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    return code, first, d.min(axis=1)


def above(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * MARGIN


def below(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * MARGIN


class Moves:
    """What bounds of one part position need: how far entries went, and half the distance to the nearest other entry."""

    def __init__(self, old: np.ndarray, book: np.ndarray):
        self.own = above(np.sqrt(squares(book - old)))
        order = np.sort(self.own)
        self.others = np.where(self.own == order[-1], order[-2] if len(order) > 1 else 0.0, order[-1])  # of equals at the top both are
        apart = (squares(book)[:, None] - 2 * exact_products(book, book) + squares(book)[None, :]).astype(float)
        np.fill_diagonal(apart, np.inf)
        self.half = below(np.sqrt(apart.min(axis=1)) / 2)


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, moves: Moves) -> int:
    """Entries and bounds of parts after a move of the entries, in place; the number of parts that were scanned."""
    upper[:] = above(upper + moves.own[code])
    lower[:] = below(lower - moves.others[code])
    least = np.maximum(lower, moves.half[code])
    some = np.flatnonzero(~(upper < least))
    upper[some] = above(np.sqrt(squares(x[some] - book[code[some]])))
    some = some[~(upper[some] < least[some])]
    if len(some):
        code[some], first, second = scan(x[some], book)
        upper[some], lower[some] = above(np.sqrt(first)), below(np.sqrt(second))
    return len(some)


STATE = "k {key}, label {label}, x binary, code binary, upper binary, lower binary"


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each vector that is there and has finite components only.

    code has two hex digits (more above 256 entries) for each part, error is the sum of the parts' squared distances to their
    entries, label_error its sum over the rows of one label (null where it exceeds 64 bits; null labels are one label).
    The first entries are the parts of the smallest keys, of equal keys of the smaller vector; null keys come last. Of
    fewer vectors than entries each gives one. Repeated rows each count. Vectors of another length than the longest, or one
    that can't be cut evenly, are filled with zeros. Whole components are held to what 64-bit distances allow (2 ** 27 for 64
    of them). Empty vectors are zeros. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.where(finite(F.col(vector))).select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return vectors.where("false").select(F.col(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = max(1, -(-longest // parts))
    limit = min(2**31 - 1, math.isqrt(2**60 // (width * parts)))
    seeds = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = whole_numbers(pa.array([r.v for r in seeds], pa.list_(pa.float64())), width * parts, scale, limit)
    books = [np.ascontiguousarray(seeds[:, p * width : (p + 1) * width]).astype(np.int64) for p in range(parts)]
    state = STATE.format(key=kinds[key], label=kinds[label])
    codes = np.uint8 if entries <= 256 else np.int32

    def packed(b: pa.RecordBatch, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
        cols = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, code.astype(codes), upper, lower)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["k", "label", "x", "code", "upper", "lower"])

    def unpacked(column: pa.Array, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).copy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole_numbers(b.column(2), width * parts, scale, limit)
            code, upper, lower = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts)), np.zeros((len(x), parts))
            for p, book in enumerate(books):
                code[:, p], d, e = scan(x[:, p * width : (p + 1) * width], book)
                upper[:, p], lower[:, p] = above(np.sqrt(d)), below(np.sqrt(e))
            yield packed(b, x, code, upper, lower)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(books[0])
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for b in batches:
            x, code = unpacked(b.column(0), np.int32).astype(np.int64), unpacked(b.column(1), codes).astype(np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                count[p] += np.bincount(code[:, p], minlength=size)
        p, e = np.nonzero(count)
        rows = np.repeat(np.arange(len(p)), width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (p[rows[0]], e[rows[0]], rows[1], count[p, e][rows[0]], total[p, e].ravel())], names=["p", "e", "i", "n", "s"])

    def move(books: list[np.ndarray], moves: list[Moves]):
        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, code = unpacked(b.column(2), np.int32), unpacked(b.column(3), codes).astype(np.int64)
                upper, lower = unpacked(b.column(4), np.float64), unpacked(b.column(5), np.float64)
                for p, book in enumerate(books):
                    c, u, w = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    reassign(x[:, p * width : (p + 1) * width].astype(np.int64), c, u, w, book, moves[p])
                    code[:, p], upper[:, p], lower[:, p] = c, u, w
                yield packed(b, x, code, upper, lower)

        return moved

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code = unpacked(b.column(2), np.int32).astype(np.int64), unpacked(b.column(3), codes)
            error = sum(squares(x[:, p * width : (p + 1) * width] - book[code[:, p]]) for p, book in enumerate(books))
            text = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error)], names=["k", "label", "code", "error"])

    table = written(rows.mapInArrow(first, state), "codes")
    for _ in range(rounds):
        found = table.select("x", "code").mapInArrow(sums, "p long, e long, i long, n long, s long").groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        old, books = books, [b.copy() for b in books]
        for r in found.collect():  # entries * width numbers
            books[r.p][r.e, r.i] = r.s // r.n
        table = written(table.mapInArrow(move(books, [Moves(a, b) for a, b in zip(old, books, strict=True)]), state), "codes")
    coded = written(table.mapInArrow(errors, f"k {kinds[key]}, label {kinds[label]}, code string, error long"), "coded")
    by_label = written(coded.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error")), "labels")
    if by_label.count() <= BROADCAST_CELLS:
        by_label = F.broadcast(by_label)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("same")), "left")
    return out.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
