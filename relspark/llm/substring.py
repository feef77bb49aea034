"""Repeated passages by relative Lempel-Ziv parsing against an index of the whole corpus, dealt into blocks.

Each window of WINDOW words has an anchor: its leftmost GRAM-word gram of least hash, which only depends on the window's
words. Consecutive windows with the same anchor are a stretch. The reference is the set of different stretches; its blocks
are dealt by anchor, so all that a window can repeat lies in one block, and a text is parsed against exactly the blocks that
its stretches belong to. A stretch whose whole content occurs again is one factor, which a count of contents tells. The
others are parsed in their block (parse_block): from the left, the longest run of words that another stretch of the block
also has is a factor if it has at least WINDOW words, else one word is passed over. The windows that reach over a factor's
end are looked up next, so that no repeat across a boundary is missed. The factors are the duplicate spans.

An anchor of more than MOST different stretches isn't gathered in one task: its windows are factors of exactly WINDOW
words, looked up one by one in an index dealt by the window's hash.

Equal windows have equal anchors, so none is missed. Words are taken as equal by 64-bit hashes, stretches by two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

WINDOW = 35
GRAM = 12
BASE = 0x9E3779B97F4A7C15 | 1
SHIFT = 5  # bits for the number of windows in a stretch, at most WINDOW - GRAM + 1, and for its anchor's place
LOW = (1 << SHIFT) - 1
#: Most different stretches of an anchor that are parsed together.
MOST = 4096
#: Stretches that a task parses at a time, but for those of one anchor.
TOGETHER = 1 << 15


SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM d),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.j = x.j GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


class WordHashes(dict):
    """Hash of each word; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as many as the longest text needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            steps = np.ones((2, size), np.uint64)
            steps[0, 1:], steps[1, 1:] = BASE, pow(BASE, -1, 1 << 64)
            self.up, self.down = np.cumprod(steps, axis=1)
        return self.up, self.down


WORDS = WordHashes()
POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix(words: list[bytes]) -> np.ndarray:
    """Prefix sums from which between() has the hash of any run of words."""
    n = len(words)
    up, _ = POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.fromiter(map(WORDS.__getitem__, words), np.uint64, n) * up[:n], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * POWERS.to(len(sums))[1][start]


def least_places(x: np.ndarray, width: int, step: int = 1 << 16) -> np.ndarray:
    """Place of the leftmost least value in each run of `width` values, some runs at a time."""
    n = len(x) - width + 1
    out = np.empty(n, np.int64)
    for at in range(0, n, step):
        end = min(at + step, n)
        out[at:end] = np.lib.stride_tricks.sliding_window_view(x[at : end + width - 1], width).argmin(axis=1)
    return out + np.arange(n)


def stretches(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, stretch, place) of a text's stretches, in order. place: first window, words before the anchor, windows."""
    n = len(words)
    if n < window:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64)
    sums = prefix(words)
    grams = np.arange(n - gram + 1)
    least = mix(between(sums, grams, grams + gram))
    at = least_places(least, window - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    count = np.diff(np.concatenate((first, [len(at)])))
    content = between(sums, first, first + count + window - 1)
    before = at[first] - first
    shape = ((before << SHIFT | count) + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return least[at[first]], mix(content ^ shape), (first << SHIFT | before) << SHIFT | count


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 2 * SHIFT, place >> SHIFT & LOW, place & LOW


def parse_block(group: np.ndarray, place: np.ndarray, ask: np.ndarray, words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the factors of the asking stretches against the other stretches of their group.

    Stretches of a group have one anchor and stand aligned by it in a matrix of word hashes, so that two of them share
    the run of words from column a to b if their sums between the columns agree.
    """
    none = np.zeros(0, np.int64)
    if not len(group):
        return none, none, none
    first, before, count = unpacked(place)
    most = window - gram  # words that may stand before an anchor
    left, size = most - before, count + window - 1
    right = left + size
    flat = np.frombuffer(b"".join(words), np.uint64)
    steps = np.ones(most + window, np.uint64)
    steps[1:] = BASE
    sums = np.zeros((len(group), most + window + 1), np.uint64)
    row = np.repeat(np.arange(len(group)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size - left, size)
    sums[row, column + 1] = flat
    sums[:, 1:] *= np.cumprod(steps)
    np.cumsum(sums, axis=1, out=sums)

    def shared(rows: np.ndarray, kind: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Class of each row by kind and words from a to b, and whether the class has other rows."""
        key = mix(sums[rows, b] - sums[rows, a]) ^ (kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, classes, n = np.unique(key, return_inverse=True, return_counts=True)
        return classes, n[classes] > 1

    todo = np.where(ask, left, most + window + 1)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(most + 1):
        rows = np.flatnonzero((left <= a) & (a + window <= right))
        if not (todo[rows] <= a).any():
            continue
        kind, again = shared(rows, group[rows], a, a + window)
        rows, kind = rows[again], kind[again]
        end = np.where(todo[rows] <= a, a + window, 0)  # of the factor that begins at a
        live, of = np.arange(len(rows)), kind
        for b in range(a + window + 1, most + window + 1):
            longer = right[rows[live]] >= b
            live, of = live[longer], of[longer]
            if not (end[live] == b - 1).any():
                break
            of, again = shared(rows[live], of, a, b)
            live, of = live[again], of[again]
            end[live[end[live] == b - 1]] = b
        found = end > 0
        rows, end = rows[found], end[found]
        out.append((rows, first[rows] + a - left[rows], first[rows] + end - left[rows]))
        todo[rows] = end - window + 1  # what lies inside the factor needs no look-up
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def parse(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, carry: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(key, text, n_words, spans, kept) and the columns to carry: spans are (first word, end) of duplicate spans, kept the other words.

    A word goes if a window that covers it also starts anywhere else, in the same text or another; all windows are
    judged on the input. Null and empty texts have no words; texts of fewer than `window` words keep all. Each row
    is a text of its own, whatever its key: rows with a null key and rows of a repeated key are judged and come out like
    any other, and equal texts repeat each other. Other columns are ignored. No spans: null, so that an untouched text
    is easily told.
    """
    spark = docs.sparkSession
    if not 0 < gram <= window < gram + LOW:
        raise ValueError(f"a window may hold at most {LOW} grams")
    small_batches(spark)
    carry = carry or []
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(carry)])
    docs = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), rest.alias("c"))
    kind, kind_c = docs.schema["k"].dataType.simpleString(), docs.schema["c"].dataType.simpleString()
    docs = written(docs.select(F.monotonically_increasing_id().alias("id"), "k", "t", "c"), "texts")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], []]
            row = []
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                found = stretches((t.as_py() or b"").split(), window, gram)
                if len(found[0]):
                    row.append(np.full(len(found[0]), i))
                    for c, x in zip(cols, found, strict=True):
                        c.append(x.view(np.int64))
            if row:
                a, s, at = (pa.array(np.concatenate(c)) for c in cols)
                yield pa.RecordBatch.from_arrays([a, s, b.column(0).take(pa.array(np.concatenate(row))), at], names=["anchor", "stretch", "id", "at"])

    every = written(docs.select("id", "t").mapInArrow(index, "anchor long, stretch long, id long, at long"), "stretches")
    again = every.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("stretch") == F.max("stretch")).alias("same")).where("n > 1")
    again = written(again.select("anchor", "same"), "again")  # a join of two shuffled tables splits hot anchors
    found = written(every.join(again, "anchor"), "repeated")
    mixed = found.where("NOT same").drop("same")
    kinds = written(mixed.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("id", "at")).alias("one")), "kinds")
    unsure = kinds.groupBy("anchor").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 AND kinds > 1")
    unsure = written(unsure.select("anchor", (F.col("kinds") > most).alias("hot")), "unsure")
    whole = found.where("same").select("id", "at").unionByName(mixed.join(kinds.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"]).select("id", "at"))
    whole = whole.select("id", F.expr(f"shiftright(at, {2 * SHIFT})").alias("first"), F.expr(f"shiftright(at, {2 * SHIFT}) + (at & {LOW}L) + {window - 1}").alias("end"))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "id", "at", "ask", "words"]
        for b in batches:
            for t, e, i in zip(b.column(2).cast(pa.binary()), b.column(4), b.column(0).to_pylist(), strict=True):
                if not e.is_valid:
                    continue
                words = (t.as_py() or b"").split()
                hashes = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
                at, anchor, ask = (e.values.field(n) for n in range(3))
                start, _, n = unpacked(at.to_numpy())
                for lo in range(0, len(start), 1 << 14):
                    some = slice(lo, lo + (1 << 14))
                    data = [hashes[x:y].tobytes() for x, y in zip(start[some].tolist(), (start + n + window - 1)[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([anchor[some], pa.array(np.full(len(data), i)), at[some], ask[some], pa.array(data, pa.binary())], names=names)

    def held(of: DataFrame) -> DataFrame:
        """The words of one stretch of each content of these anchors. The join deals the texts as the last one does, so that they are shuffled once."""
        check = kinds.join(of, "anchor").select("one.id", F.struct("one.at", "anchor", (F.col("n") == 1).alias("ask")).alias("e"))
        check = check.groupBy("id").agg(F.collect_list("e").alias("e"))  # at most the stretches of one text
        return docs.join(check, "id", "left").select("id", "k", "t", "c", "e").mapInArrow(contents, "anchor long, id long, at long, ask boolean, words binary")

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed(cols: list) -> pa.RecordBatch:
            anchor, ids, at, ask, words = cols
            row, start, end = parse_block(anchor, at, ask, words, window, gram)
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(start), pa.array(end)], names=["id", "first", "end"])

        cols: list | None = None
        for b in batches:
            new = [*(c.to_numpy(zero_copy_only=False) for c in b.columns[:4]), b.column(4).to_pylist()]
            cols = new if cols is None else [np.concatenate((p, q)) if isinstance(p, np.ndarray) else p + q for p, q in zip(cols, new, strict=True)]
            if len(cols[0]) >= TOGETHER:
                borders = np.flatnonzero(np.diff(cols[0]))  # the last anchor may go on in the next batch
                if len(borders):
                    yield parsed([c[: borders[-1] + 1] for c in cols])
                    cols = [c[borders[-1] + 1 :] for c in cols]
        if cols:
            yield parsed(cols)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, ids, at, ask = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            first, before, count = unpacked(at)
            for lo in range(0, len(anchor), 1 << 12):
                part, hashes = range(lo, min(lo + (1 << 12), len(anchor))), []
                for i in part:
                    x = np.frombuffer(b.column(4)[i].as_buffer(), np.uint64)
                    steps = np.ones(len(x), np.uint64)
                    steps[1:] = BASE
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(steps))))
                    start = np.arange(count[i])
                    hashes.append(mix(between(sums, start, start + window)).view(np.int64))
                n = count[list(part)]
                spread = lambda x, n=n, part=part: pa.array(np.repeat(x[list(part)], n))
                start = np.repeat(first[list(part)] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([spread(anchor), pa.array(np.concatenate(hashes)), spread(ids), pa.array(start), spread(ask)], names=["anchor", "h", "id", "first", "ask"])

    cool = held(unsure.where("NOT hot").select("anchor")).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
    spans = whole.unionByName(cool.mapInArrow(factors, "id long, first long, end long"))
    if not unsure.where("hot").isEmpty():
        one = written(held(unsure.where("hot").select("anchor")).mapInArrow(windows, "anchor long, h long, id long, first long, ask boolean"), "windows")
        twice = one.groupBy("anchor", "h").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "h")
        spans = spans.unionByName(one.where("ask").join(twice, ["anchor", "h"]).select("id", "first", F.expr(f"first + {window}").alias("end")))
    spans = spans.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("s"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, out, kept = [], [], []
            for t, s in zip(b.column(2).cast(pa.binary()), b.column(4), strict=True):
                words = (t.as_py() or b"").split()
                n = len(words)
                number.append(n)
                if not s.is_valid:
                    out.append(None)
                    kept.append(b" ".join(words))
                    continue
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, s.values.field(0).to_numpy(), 1)
                np.add.at(step, s.values.field(1).to_numpy(), -1)
                gone = np.cumsum(step[:n]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                out.append([{"first": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
                kept.append(b" ".join(compress(words, (~gone).tolist())))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(1), b.column(2), b.column(3), pa.array(number, pa.int64()), pa.array(out, span), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "t", "c", "n_words", "spans", "kept"])

    out = docs.join(spans, "id", "left").select("id", "k", "t", "c", "s").mapInArrow(keep, f"k {kind}, t string, c {kind_c}, n_words long, spans array<struct<first: long, end: long>>, kept string")
    return out.select(F.col("k").alias(key), F.col("t").alias(text), "n_words", "spans", "kept", *[F.col(f"c.c{n}").alias(c) for n, c in enumerate(carry)])
