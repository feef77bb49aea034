"""Near duplicates among vectors by collision-counting projections.

Every vector is projected on COUNTED random lines. Sorted along a line, a vector's window holds what lies within a
fixed distance of its own place; two vectors collide on the line if one is in the other's window. A pair at the wanted
cosine collides on each line with the same known probability, independently, so the least count that such a pair
reaches but for MISSED of all cases is a binomial quantile; pairs that reach it are verified in double precision.

Counting is done in cells, not over all pairs. A cell holds the vectors that lie on the same side of each of some other
lines; tables of such cells are made until a pair at the wanted cosine misses all of them in MISSED of all cases. The
lines of a table grow with the logarithm of the number of vectors, so that cells keep their size. Cells above BLOCK
vectors are split, each pair of blocks being counted in a task of its own. A pair counts in the first table that it
shares; a task returns sums of links by vector and edges of a spanning forest, never the pairs.

Why cells: on a line, the window of a vector holds about four in ten of all vectors, whatever their number (a pair at the
cosine of 0.95 lies up to half a standard deviation apart), so counting over all vectors costs 0.4 n * n for each line.

Equal vectors are one class: they are linked without being compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_blocks, connected_components, small_batches, written
from .simhash import Forest

COSINE = 0.95
MISSED = 0.001
CELL = 512
BLOCK = 2048
COUNTED = 40
#: Half of a window, in standard deviations of the places' difference of a pair at the wanted cosine.
REACH = 1.65


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, nullif(sqrt(list_inner_product(v, v)), 0) AS n FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
l AS (SELECT node, min(root) AS root FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT node AS vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, node = root AS kept FROM l LEFT JOIN n ON n.a = l.node
"""


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Lines of a table and number of tables for n vectors."""
    lines = max(0, math.ceil(math.log2(max(n, 1) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** lines
    return lines, 1 if same >= 1 else math.ceil(math.log(MISSED) / math.log1p(-same))


def least_count(lines: int = COUNTED, reach: float = REACH, missed: float = MISSED) -> int:
    """Largest count that a pair at the wanted cosine reaches in all but `missed` of all cases."""
    p = math.erf(reach / math.sqrt(2))
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if below > missed:
            return k
    return lines


def directions(dimensions: int, lines: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Random lines: for the tables (dimensions, tables * lines) and for counting (dimensions, COUNTED)."""
    rng = np.random.default_rng(dimensions)
    counted = rng.standard_normal((dimensions, COUNTED))
    return rng.standard_normal((dimensions, tables * lines)), counted


def cells_of(unit: np.ndarray, routing: np.ndarray, lines: int, tables: int) -> np.ndarray:
    """Cell number of each vector in each table (vectors, tables), without the table's own number."""
    side = (unit @ routing > 0).reshape(len(unit), tables, lines)
    return side @ (1 << np.arange(lines, dtype=np.int64)) if lines else np.zeros((len(unit), tables), np.int64)


def windows(place: np.ndarray, query: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line: each vector's rank in sorted order, and each query's first rank and number of ranks in its window."""
    ranks = np.empty(place.shape, np.uint16)
    first, size = np.empty(query.shape, np.uint16), np.empty(query.shape, np.uint16)
    for k in range(place.shape[1]):
        order = np.argsort(place[:, k])
        ranks[order, k] = np.arange(len(order))
        line = place[order, k]
        first[:, k] = np.searchsorted(line, query[:, k] - half, "left")
        size[:, k] = np.searchsorted(line, query[:, k] + half, "right") - first[:, k]
    return ranks, first, size


def candidates(a: np.ndarray, b: np.ndarray, counted: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with a[i] and b[j] colliding often enough, some rows of a at a time. At most 65535 rows of b."""
    need, half = least_count(), REACH * math.sqrt(2 - 2 * cosine)
    ranks, first, size = windows(b @ counted, a @ counted, half)
    ranks = np.ascontiguousarray(ranks.T)
    for at in range(0, len(a), 256):
        rows = slice(at, at + 256)
        count = np.zeros((len(a[rows]), len(b)), np.uint8)
        for k in range(len(ranks)):
            count += (ranks[k][None, :] - first[rows, k, None]) < size[rows, k, None]
            if k == len(ranks) // 2 and (count + (len(ranks) - k - 1)).max(initial=0) < need:
                break
        i, j = np.nonzero(count >= need)
        yield at + i, j


def linked(x: np.ndarray, ids: np.ndarray, weight: np.ndarray, side: np.ndarray, table: int, lines: int, tables: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of a group (weights of those it is linked with), and spanning edges."""
    norm = np.sqrt((x * x).sum(axis=1))
    unit = x / norm[:, None]
    routing, counted = directions(x.shape[1], lines, tables)
    routing = routing[:, : table * lines]  # of the tables before this one
    whole = side[0] == 0
    mine = np.arange(len(x)) if whole else np.flatnonzero(side == 1)
    theirs = np.arange(len(x)) if whole else np.flatnonzero(side == 2)
    links, forest, edges = np.zeros(len(x), np.int64), Forest(), []
    root = np.arange(len(x))
    for i, j in candidates(unit[mine], unit[theirs], counted, cosine):
        i, j = mine[i], theirs[j]
        if whole:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
            p, q = p[good], q[good]
            if table and len(p):  # a link counts in the first table that it shares; only links' ends are looked up
                some, at = np.unique(np.concatenate((p, q)), return_inverse=True)
                cells = cells_of(unit[some], routing, lines, table)
                good = ~(cells[at[: len(p)]] == cells[at[len(p) :]]).any(axis=1)
                p, q = p[good], q[good]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            apart = root[p] != root[q]
            for c, d in zip(p[apart].tolist(), q[apart].tolist(), strict=True):
                if forest.join(c, d):
                    edges.append((int(ids[c]), int(ids[d])))
            if apart.any():
                root = np.array([forest.root(r) for r in range(len(x))])
    return links, edges


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept) of each row.

    n_links counts the other rows with a cosine of at least `cosine`, component_id is the smallest key reachable over
    links, itself included. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing,
    as do rows without a key; vectors of different length don't link. Repeated rows link with each other. Keys are
    longs; other columns are ignored. A link is found with a probability of about 0.998 at the given cosine, higher above.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    square = "aggregate(v, 0.0D, (a, x) -> a + x * x)"
    fit = F.expr(f"k IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND {square} > 0 AND {square} < double('Infinity')")
    rows = rows.withColumn("v", F.when(F.coalesce(fit, F.lit(False)), F.col("v")))
    classes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("k").alias("rep"), F.count("*").alias("n")), "vectors")
    lines, tables = plan(classes.count(), cosine)
    small_batches(spark)
    #: Floats travel as floats; all arithmetic is in double precision.
    stored = np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                some = np.flatnonzero(sizes == d)
                x = flat[starts[some][:, None] + np.arange(d)]
                cells = cells_of(x / np.sqrt((x * x).sum(axis=1))[:, None], directions(int(d), lines, tables)[0], lines, tables)
                data = pa.array([r.tobytes() for r in x.astype(stored)], pa.binary())
                for t in range(tables):
                    cell = ((np.int64(d) * 1021 + t) << np.int64(lines)) + cells[:, t]
                    take = pa.array(some)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(some), t), pa.int32()), b.column(1).take(take), b.column(2).take(take), data], names=["cell", "t", "rep", "n", "x"])

    dealt = classes.select("v", "rep", "n").mapInArrow(deal, "cell long, t int, rep long, n long, x binary")
    dealt = cell_blocks(dealt, ["rep"], BLOCK).select("cell", "i", "j", "side", "t", "rep", "n", "x")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(cols: list, lo: int, hi: int) -> tuple[list, list, list]:
            side, t, rep, n, x = (c[lo:hi] for c in cols[3:])
            if hi - lo < 2:
                return [], [], []
            every = np.frombuffer(b"".join(x), stored).astype(np.float64).reshape(hi - lo, -1)
            links, edges = linked(every, rep, n, side, int(t[0]), lines, tables, cosine)
            some = np.flatnonzero(links)
            return [*rep[some].tolist(), *(a for a, _ in edges)], [*[None] * len(some), *(b for _, b in edges)], [*links[some].tolist(), *[None] * len(edges)]

        held: list | None = None
        for b in _with_end(batches):
            if b is not None:
                cols = [*(c.to_numpy() for c in b.columns[:7]), b.column(7).to_pylist()]
                held = cols if held is None else [np.concatenate((p, q)) if isinstance(p, np.ndarray) else p + q for p, q in zip(held, cols, strict=True)]
            if held is None:
                continue
            cut = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            ends = [*cut.tolist(), len(held[0])] if b is None else cut.tolist()
            at, a, c, n = 0, [], [], []
            for end in ends:
                for out, more in zip((a, c, n), group(held, at, end), strict=True):
                    out += more
                at = end
            held = [x[at:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, c, n)], names=["a", "b", "n"])

    found = written(dealt.mapInArrow(compare, "a long, b long, n long"), "links")
    sums = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    labels = connected_components(found.where("b IS NOT NULL"))
    known = classes.join(sums, F.col("rep") == F.col("a"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    # Rows find their class by 128 bits of hash, so that no vector is shuffled again.
    both = [F.xxhash64("v").alias("h0"), F.xxhash64(F.lit(1), F.reverse("v")).alias("h1")]
    known = known.select(*both, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("k", *[F.when(F.col("v").isNotNull(), h).alias(f"h{n}") for n, h in enumerate(both)]).join(known, ["h0", "h1"], "left").select("k", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
