"""Near duplicates by SimHash fingerprints, compared bit-sliced.

Fingerprints are grouped into cells such that near ones share a cell. In a cell they are stored as bit planes, 64 to a
word; the XOR of a plane with a query's bit is added to 64 distances at once by carry-save adders, and words in which
every distance exceeds the radius are abandoned. Cells above HOT fingerprints are split into blocks, and each pair of
blocks is compared in a task of its own.

Plan "exact" (64 bits, RADIUS): fingerprints at most four bits apart agree on two of six bit fields, so the cells of
all fifteen pairs of fields miss none. A cell gives the edges of a spanning forest only.

Plan "similar": WIDE bits of the set of shingles only find candidates, and documents are linked if the exact Jaccard
similarity of their shingle sets reaches the wanted one. Rows are classes of equal sets. The radius is what all but one
in a thousand pairs of that similarity keep; cells are bands of bits, as many as let all but one in a thousand such pairs
share one. The length of a band grows with the logarithm of the number of classes. A cell gives a spanning forest of its
candidates; what they join is a family. A family's texts meet in one task (families above HOT in a task for each pair of
blocks), where its fingerprints are compared with each other and the pairs within the radius that no link joins yet
are verified, the nearest first. So each text travels once for each block of its family, no candidate pair leaves its task, and no
candidate's link is lost. (Families of N texts above HOT cost N * N / HOT texts moved.)
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cell_blocks, connected_components, small_batches, written
from .substring import mix

RADIUS = 4
SEED = 42
HOT = 4096
WIDE = 256
#: Share of pairs at the wanted similarity that the bands may miss, and deviations that the radius allows (one in a thousand).
MISS, DEVIATIONS = 0.001, 3.1
FIELDS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: bytes | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of A-Z-lowered text; of the whole sequence if it is shorter, none without words."""
    words = (data or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([xx(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1))
    return np.array([xx(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    bits = np.zeros(64, np.int64)
    every = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(every), 1 << 16):
        bits += np.unpackbits(every[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(every), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, k: int = 4, bits: int = 64) -> list[int]:
    """64 bits over all shingles, or more over the set of shingles, whose further words rehash the first ones."""
    hashes = shingles(data, k)
    if bits == 64:
        return [majority(hashes)]
    return widened(np.unique(hashes), bits)


def widened(hashes: np.ndarray, bits: int) -> list[int]:
    out = []
    for n in range(bits // 64):
        out.append(majority(hashes))
        hashes = mix(hashes + np.uint64(n + 1))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, bits: int = 64) -> DataFrame:
    """(key, f0, f1, ... long) of each document; null and word-less texts get 0."""
    small_batches(docs.sparkSession)
    names = [f"f{n}" for n in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, k, bits) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(f).view(np.int64)) for f in fps.T)], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in names))


def set_fingerprints(docs: DataFrame, row: str, text: str, k: int, bits: int = WIDE) -> DataFrame:
    """(row, f0, ..., s0, s1, size): fingerprint, 128-bit hash and size of each document's set of shingles."""
    small_batches(docs.sparkSession)
    names = [*(f"f{n}" for n in range(bits // 64)), "s0", "s1", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).cast(pa.binary()):
                hashes = np.unique(shingles(x.as_py(), k))
                whole = xxhash.xxh3_128_intdigest(hashes.tobytes(), SEED)
                rows.append([*widened(hashes, bits), whole >> 64, whole & int(ONES), len(hashes)])
            columns = np.array(rows, np.uint64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns)], names=[row, *names])

    return docs.select(row, F.col(text).cast("string")).mapInArrow(run, f"`{row}` long, " + ", ".join(f"{n} long" for n in names))


class Counter:
    """Distances of many words of 64 lanes: bit planes up to the radius's length, and what ran over them."""

    def __init__(self, size: int, radius: int) -> None:
        self.radius = radius
        self.planes = [np.zeros(size, np.uint64) for _ in range(radius.bit_length())]
        self.full = np.zeros(size, np.uint64)

    def add(self, xs: list[np.ndarray]) -> None:
        """Adds several planes of weight 1: three numbers become a sum and a carry until one is left of each weight."""
        column = xs
        for k, c in enumerate(self.planes):
            column, carries = [c, *column], []
            while len(column) > 1:
                a, b = column.pop(), column.pop()
                if column:
                    d = column.pop()
                    t = a ^ b
                    carries.append((a & b) | (t & d))
                    column.append(t ^ d)
                else:
                    carries.append(a & b)
                    column.append(a ^ b)
            self.planes[k], column = column[0], carries
        for x in column:
            self.full |= x

    def over(self) -> np.ndarray:
        """Lanes above the radius."""
        out, equal = self.full.copy(), ~self.full
        for k in range(len(self.planes) - 1, -1, -1):
            if self.radius >> k & 1:
                equal &= self.planes[k]
            else:
                out |= equal & self.planes[k]
                equal &= ~self.planes[k]
        return out

    def keep(self, which: np.ndarray) -> None:
        self.planes, self.full = [p[which] for p in self.planes], self.full[which]


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, blocks) of fingerprints (blocks, 64, words)."""
    blocks, _, words = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(blocks, 64, 8 * words), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def near(queries: np.ndarray, planes: np.ndarray, valid: np.ndarray, q: np.ndarray, b: np.ndarray, radius: int, step: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of what is within the radius; row r compares query q[r] with the 64 lanes of block b[r]."""
    rows, lanes = [], []
    for at in range(0, len(q), 1 << 15):
        alive = np.arange(at, min(at + (1 << 15), len(q)))
        mine, block, count, over = queries[q[alive]], b[alive], Counter(len(alive), radius), None
        use = valid[block]
        for p in range(0, len(planes), step):
            some = range(p, min(p + step, len(planes)))
            count.add([planes[i][block] ^ (np.uint64(0) - ((mine[:, i >> 6] >> np.uint64(i & 63)) & np.uint64(1))) for i in some])
            if some[-1] + 1 <= radius:
                continue
            over = count.over()
            left = (~over & use) != 0
            if left.sum() < 0.8 * len(left):
                alive, mine, block, use, over = alive[left], mine[left], block[left], use[left], over[left]
                count.keep(left)
                if not len(alive):
                    break
        if len(alive):
            hit = np.unpackbits((~over & use).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            rows.append(alive[i])
            lanes.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(lanes)) if rows else (none, none)


class Forest:
    """Union-find that says which edges join two trees."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def hits(group: np.ndarray, side: np.ndarray, fps: np.ndarray, rep: np.ndarray, radius: int, size: np.ndarray | None = None, similarity: float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y), the rows of pairs within the radius, in parts, the nearest of a part first if there are sizes; sets too unequal in size
    to be similar are then left out."""
    if not len(group):
        return
    first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    length = np.diff(np.concatenate((first, [len(group)])))
    number = np.repeat(np.arange(len(first)), length)
    lane = np.flatnonzero((side != 1) & (length[number] > 1))
    query = np.flatnonzero((side != 2) & (length[number] > 1))
    lanes = np.bincount(number[lane], minlength=len(first))
    queries = np.bincount(number[query], minlength=len(first))
    lane_at, query_at = np.cumsum(lanes) - lanes, np.cumsum(queries) - queries
    todo, at = np.flatnonzero((lanes > 0) & (queries > 0)), 0
    while at < len(todo):  # groups of up to some thousand blocks together
        blocks = -(-lanes[todo[at:]] // 64)
        n = max(1, int(np.searchsorted(np.cumsum(blocks), 2048, side="right")))
        some, blocks = todo[at : at + n], blocks[:n]
        at += n
        base = np.cumsum(blocks) - blocks
        which = np.repeat(np.arange(n), lanes[some])
        place = np.arange(len(which)) - np.repeat(np.cumsum(lanes[some]) - lanes[some], lanes[some])
        member = lane[lane_at[some][which] + place]
        slot = 64 * base[which] + place
        held = np.zeros((64 * int(blocks.sum()), fps.shape[1]), np.uint64)
        held[slot] = fps[member]
        back = np.zeros(len(held), np.int64)
        back[slot] = member
        used = np.zeros(len(held), np.uint8)
        used[slot] = 1
        valid = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
        planes = planes_of(held.reshape(-1, 64, fps.shape[1]))
        which = np.repeat(np.arange(n), queries[some])
        place = np.arange(len(which)) - np.repeat(np.cumsum(queries[some]) - queries[some], queries[some])
        asks = query[query_at[some][which] + place]
        step = 1 << 13 if size is None else min(1 << 13, max(1, (1 << 15) // int(blocks.max())))  # two million hits at most
        for part in range(0, len(asks), step):
            mine, of = asks[part : part + step], which[part : part + step]
            q = np.repeat(np.arange(len(mine)), blocks[of])
            b = np.repeat(base[of], blocks[of]) + np.arange(len(q)) - np.repeat(np.cumsum(blocks[of]) - blocks[of], blocks[of])
            r, j = near(fps[mine], planes, valid, q, b, radius)
            x, y = mine[q[r]], back[64 * b[r] + j]
            use = (rep[x] != rep[y]) & ((side[x] != 0) | (x < y))
            if size is not None:
                use &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) * (1 - 1e-9)
            x, y = x[use], y[use]
            if size is not None:
                order = np.argsort(np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64), kind="stable")
                x, y = x[order], y[order]
            if len(x):
                yield x, y


def edges_of_groups(group: np.ndarray, side: np.ndarray, fps: np.ndarray, rep: np.ndarray, radius: int, size: np.ndarray | None = None, similarity: float = 0.0, same: Callable[[int, int], bool] | None = None) -> Iterator[tuple[list, list]]:
    """Edges of spanning forests within runs of equal group numbers, in parts. side: 0 in groups compared with themselves,
    else 1 with 2. With same(), rows are joined only by pairs for which it holds."""
    forest, root = Forest(), np.arange(len(rep))
    for x, y in hits(group, side, fps, rep, radius, size, similarity):
        apart = root[x] != root[y]
        left: list = []
        right: list = []
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if forest.root(i) != forest.root(j) and (same is None or same(i, j)):
                forest.join(i, j)
                left.append(int(rep[i]))
                right.append(int(rep[j]))
        if left:
            root = np.fromiter(map(forest.root, range(len(rep))), np.int64, len(rep))
            yield left, right


def field_cells() -> list[Column]:
    """Cells by pairs of bit fields of f0: near fingerprints share at least one."""
    part = lambda at, w: F.shiftrightunsigned("f0", at).bitwiseAND(F.lit((1 << w) - 1))
    return [F.lit(n << 22).cast("long") + F.shiftleft(part(*a), b[1]) + part(*b) for n, (a, b) in enumerate(combinations(FIELDS, 2))]


def apart(similarity: float) -> float:
    """Share of bits in which SimHash fingerprints of sets of that Jaccard similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def similar_radius(similarity: float, bits: int = WIDE) -> int:
    p = apart(similarity)
    return math.floor(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def with_bands(reps: DataFrame, n: int, similarity: float, bits: int = WIDE) -> DataFrame:
    """reps with their cells by bands of fixed pseudo-random bits, for n classes."""
    length = min(30, max(12, round(math.log2(max(n, 2))) - 6))
    bands = math.ceil(math.log(MISS) / math.log(1 - (1 - apart(similarity)) ** length))
    rng = random.Random(17)
    places = np.array([rng.sample(range(bits), length) for _ in range(bands)])
    names = [f"f{i}" for i in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([b.column(name).to_numpy() for name in names], axis=1).view(np.uint64)
            plane = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
            cells = (plane[:, places] << np.arange(length)).sum(axis=2) + (np.arange(bands) << length)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, bands, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "cells"])

    return reps.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema) + ", cells array<long>")


def in_groups(rows: DataFrame, radius: int, similarity: float | None = None, words: int | None = None, together: int = 1 << 17) -> DataFrame:
    """Edges (a, b) that span the links within groups of rows (cell, i, j, side, rep, own columns, fingerprints), sorted by groups.

    With a similarity, the first own column is the size of the set; words: shingle length for exact verification of the last column.
    """
    sized = similarity is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cols: list) -> Iterator[pa.RecordBatch]:
            cell, i, j, side, rep, *rest = cols
            number = np.cumsum(np.concatenate(([0], (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))))
            texts = rest.pop() if words else None
            size = rest.pop(0) if sized else None
            kept: dict[int, np.ndarray] = {}
            expand = zstandard.ZstdDecompressor().decompress

            def own(n: int) -> np.ndarray:
                if (found := kept.get(n)) is None:
                    found = kept[n] = np.unique(shingles(expand(texts[n]), words))
                return found

            def same(x: int, y: int) -> bool:
                p, q = own(x), own(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                return both > 0 and both / (len(p) + len(q) - both) >= similarity

            fps = np.stack(rest, axis=1).view(np.uint64)
            for x, y in edges_of_groups(number, side, fps, rep, radius, size, similarity or 0.0, same if words else None):
                yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

        held: list | None = None
        for b in batches:
            new = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns]
            held = new if held is None else [np.concatenate((p, q)) if isinstance(p, np.ndarray) else p + q for p, q in zip(held, new, strict=True)]
            if len(held[0]) >= together:  # whole groups; the last one may go on in the next batch
                changes = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
                if len(changes):
                    yield from edges([c[: changes[-1]] for c in held])
                    held = [c[changes[-1] :] for c in held]
        if held and len(held[0]):
            yield from edges(held)

    return rows.mapInArrow(run, "a long, b long")


def links(reps: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """Edges (a, b) that span the components of distinct fingerprints (f0, ..., rep, cells) within the radius.

    With a similarity, reps have sizes too and edges are candidates.
    """
    own = ["size"] if similarity is not None else []
    fields = [c for c in reps.columns if c not in ("rep", "cells", *own)]
    small_batches(reps.sparkSession)
    rows = reps.select("rep", *own, *fields, F.explode("cells").alias("cell"))
    rows = cell_blocks(rows, ["rep"] if own else fields, HOT).select("cell", "i", "j", "side", "rep", *own, *fields)
    return in_groups(rows, radius, similarity)


def verified_links(members: DataFrame, docs: DataFrame, row: str, text: str, k: int, similarity: float) -> DataFrame:
    """Edges (a, b) of exact similarity that span what is linked within each family. members: (cell, rep, size, f0, ...)."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            out = [compress(b" ".join((x.as_py() or b"").lower().split())) for x in b.column(b.schema.get_field_index("t")).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in range(len(names))), pa.array(out, pa.binary())], names=[*names, "words"])

    small_batches(docs.sparkSession)
    names = members.columns
    # The texts are dealt at every size, whether or not the members would fit into a broadcast.
    texts = docs.select(F.col(row).alias("rep"), F.col(text).cast("string").alias("t")).join(members.hint("merge"), "rep").select(*names, "t")
    held = written(texts.mapInArrow(squeeze, ", ".join(f"{c} long" for c in names) + ", words binary"), "families")
    rows = cell_blocks(held, ["rep"], HOT).select("cell", "i", "j", "side", *[c for c in names if c != "cell"], "words")
    return written(in_groups(rows, similar_radius(similarity), similarity, k, 1 << 13), "verified")


def similar_components(docs: DataFrame, row: str, text: str, k: int, similarity: float) -> DataFrame:
    """(row, f0, ..., component) over links of that exact Jaccard similarity. row: a unique long; component: a row of it."""
    fps = written(set_fingerprints(docs, row, text, k), "fingerprints")
    names = [c for c in fps.columns if c.startswith("f") and c != row]
    classes = written(fps.groupBy("s0", "s1", "size", *names).agg(F.min(row).alias("rep")), "classes")
    reps = with_bands(classes.select("rep", "size", *names), classes.count(), similarity)
    families = connected_components(links(reps, similar_radius(similarity), similarity))
    members = families.select(F.col("node").alias("rep"), F.col("component").alias("cell")).join(classes, "rep").select("cell", "rep", "size", *names)
    edges = verified_links(members, docs, row, text, k, similarity)
    labels = connected_components(edges).withColumnRenamed("node", "rep")
    classes = classes.join(labels, "rep", "left").select("s0", "s1", F.coalesce("component", "rep").alias("component"))
    return fps.join(classes, ["s0", "s1"]).select(row, *names, "component")


def components(fps: DataFrame, key: str) -> DataFrame:
    """fps with component_id, the smallest key reachable over links. Classes of equal fingerprints are the nodes."""
    classes = written(fps.groupBy("f0").agg(F.min(key).alias("least")), "classes")
    small_batches(fps.sparkSession)
    nodes = classes.select("f0", F.col("f0").alias("rep"), F.array(*field_cells()).alias("cells"))
    labels = connected_components(links(nodes, RADIUS)).withColumnRenamed("node", "f0")
    classes = written(classes.join(labels, "f0", "left").withColumn("component", F.coalesce("component", "f0")), "labels")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(classes.select("f0", "component").join(least, "component").drop("component"), "f0").select(*fps.columns, "component_id")


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs, written, with a unique long for each row."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, similarity: float | None = None) -> DataFrame:
    """(key, f0, ..., component_id) for each row: component_id is the smallest key reachable over links.

    Without a similarity, plan "exact" over 64 bits; with one, plan "similar" over WIDE bits. Null, empty and
    word-less texts have fingerprint 0 and are linked to each other; in plan "exact" like any other fingerprint. Each row
    is a document of its own, whatever its key: rows with a null key are linked like others, and their component_id is
    null only if the whole component has no key; a repeated key has a row for each of its rows. Other columns are
    ignored. An empty table gives no rows.
    """
    if similarity is None:
        return components(written(fingerprints(docs, key, text, k), "fingerprints"), key)
    rows = numbered(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "row")
    groups = written(similar_components(rows, "row", "text", k, similarity).join(rows.select("row", "key"), "row"), "groups")
    least = groups.groupBy("component").agg(F.min("key").alias("component_id"))
    return groups.join(least, "component").drop("row", "component").select(F.col("key").alias(key), *[c for c in groups.columns if c not in ("row", "component", "key")], "component_id")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest key (null last), then the smallest hash of its text."""
    row = "row"
    while row in docs.columns:
        row += "_"
    rows = numbered(docs, row)
    groups = similar_components(rows, row, text, k, similarity).join(rows.select(row, F.col(key).alias("key"), F.xxhash64(text).alias("own")), row)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "own", row)).alias("first"))
    return rows.join(first.select(F.col(f"first.{row}").alias(row)).hint("merge"), row, "left_semi").select(*docs.columns)
