"""Ranked lexical search by Block-Max WAND over an inverted index of shards.

The index is a table in the shared folder. A task cuts its documents into shards of about SHARD terms; a shard numbers its
documents by ascending key and has a row for each of its terms: postings in blocks of BLOCK, each block compressed (gaps
and frequencies as bytes of seven bits), with its last document and the maximum impact of its postings beside it.
Every term of every document is indexed; no posting is shuffled to build it.

A search joins the index with the terms asked for, so that the postings of a shard that some ITEMS items need meet in one
group. For each item, shallow pointers move over the borders of blocks only: between two borders the documents' scores are at most
the sum of the maximum impacts of the blocks there. The next pivot is the next such stretch whose bound reaches the lowest score
of the item's list so far; blocks that no pivot touches are never decompressed. Pivots are evaluated RUN at a time, in
ascending order of documents, after which the threshold rises. Lists of one block are decompressed first: their postings are
borders themselves. A task carries an item's threshold from shard to shard. Nothing is approximate: a stretch is skipped only if its bound is below
the threshold.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_CELLS, partitions, small_batches, written

#: Postings of a block, terms (with repeats) of a shard, items searched for together, pivots evaluated at a time.
BLOCK, SHARD, ITEMS, RUN = 128, 1 << 22, 256, 64
#: Rows of the index in an Arrow batch; no key (sorts after all others).
ROWS, NO_KEY = 1 << 14, 2**63 - 1
#: A to Z become small letters, other ASCII characters than digits and letters separate terms.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SQL = r"""
WITH d AS (SELECT doc_id, t.t AS term FROM documents, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(t)),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
a AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM n), m AS (SELECT doc_id, 100 - 25 + ((25 * n * nn) // l) AS m FROM n, a),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY term, nn),
q AS (SELECT item_id, t.t AS term FROM benchmark, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(t)),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLDED).split() if text else []


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2 ** 35 as groups of seven bits, the lowest first, all but the last marked; where each starts, and the end."""
    sizes = 1 + sum((values >= 1 << 7 * j).astype(np.int64) for j in range(1, 5))
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(starts[-1], np.uint8)
    for j in range(int(sizes.max(initial=0))):
        some = sizes > j
        out[starts[:-1][some] + j] = (values[some] >> 7 * j) & 127 | np.where(sizes[some] > j + 1, 128, 0)
    return out, starts


def from_bytes(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    place = np.arange(len(data)) - np.concatenate(([0], ends + 1))[np.cumsum(last) - last]
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, np.concatenate(([0], ends[:-1] + 1))) if len(data) else np.empty(0, np.int64)


INDEX = "shard long, term binary, n long, last binary, top binary, at binary, data binary"


def shard_rows(shard: int, keys: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], vocabulary: list[bytes], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: one without a term that has its documents' keys (at) and lengths norm (data), then one for each term."""
    order = np.argsort(keys, kind="stable")
    m = 75 + 25 * np.array([int(docs[i][1].sum()) for i in order], np.int64) * n_docs // max(1, n_terms)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    yield pa.RecordBatch.from_pylist([{"shard": shard, "term": None, "n": len(keys), "last": b"", "top": b"", "at": keys[order].tobytes(), "data": m.tobytes()}], schema=pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), *((c, pa.binary()) for c in ("last", "top", "at", "data"))]))
    doc = np.repeat(number, [len(d[0]) for d in docs])
    term, tf = (np.concatenate([d[i] for d in docs]).astype(np.int64) for i in (0, 1))
    by = np.lexsort((doc, term))
    doc, term, tf = doc[by], term[by], tf[by]
    begins = np.flatnonzero(np.diff(term, prepend=-1))  # every term of the vocabulary has postings, so rows are in its order
    count = np.diff(begins, append=len(term))
    place = np.arange(len(term)) - np.repeat(begins, count)
    starts = np.flatnonzero(place % BLOCK == 0)
    sizes = np.diff(starts, append=len(term))
    gap = np.diff(doc, prepend=0)
    gap[starts] = doc[starts]
    of = np.repeat(starts, sizes)
    values = np.empty(2 * len(term), np.int64)
    values[of + np.arange(len(term))] = gap
    values[of + np.arange(len(term)) + np.repeat(sizes, sizes)] = tf
    data, offset = to_bytes(values)
    top = np.maximum.reduceat(impacts(tf, m[doc]), starts).astype(np.int32)
    last = doc[starts + sizes - 1].astype(np.int32)
    blocks = -(-count // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    offset = offset[2 * starts]
    at = (offset - np.repeat(offset[first[:-1]], blocks)).astype(np.int32)
    ends = np.concatenate((offset[first[:-1]], [len(data)]))

    def column(values: np.ndarray, borders: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    four = 4 * first
    rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(begins), shard)), pa.array(vocabulary, pa.binary()), pa.array(count), column(last, four), column(top, four), column(at, four), column(data, ends)], names=["shard", "term", "n", "last", "top", "at", "data"])
    for i in range(0, len(begins), ROWS):
        yield rows.slice(i, ROWS)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int, int]:
    """The index's table, how many documents have a term, and how many terms they have with repeats.

    Null and empty texts and texts without a term have no postings. Repeated rows are documents each; rows without a key come
    last among equals. A text is never cut: one that is longer than a shard is a shard of its own. An empty table gives an empty index.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for b in batches:
            lengths = [len(terms_of(x)) for x in b.column(0).to_pylist()]
            docs, terms = docs + sum(n > 0 for n in lengths), terms + sum(lengths)
        yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})

    counts = rows.select("text").mapInArrow(count, "docs long, terms long")
    n_docs, n_terms = counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: defaultdict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        keys, held, n, shard = [], [], 0, None
        for b in batches:
            for p, k, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(terms_of, b.column(2).to_pylist()), strict=True):
                shard = p << 32 if shard is None else shard
                if not words:
                    continue
                if held and n + len(words) > SHARD:
                    yield from shard_rows(shard, np.array(keys, np.int64), held, list(vocabulary), n_docs, n_terms)
                    keys, held, n, shard = [], [], 0, shard + 1
                    vocabulary.clear()
                ids, tf = np.unique(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)), return_counts=True)
                keys.append(NO_KEY if k is None else k)
                held.append((ids, tf.astype(np.int32)))
                n += len(words)
        if held:
            yield from shard_rows(shard, np.array(keys, np.int64), held, list(vocabulary), n_docs, n_terms)

    table = rows.select(F.spark_partition_id().cast("long").alias("p"), "k", "text").mapInArrow(build, INDEX)
    return written(table, "index"), n_docs, n_terms


class Postings:
    """One term's postings in a shard; blocks are decompressed when they are first asked for."""

    def __init__(self, n: int, last: bytes, top: bytes, at: bytes, data: bytes, m: np.ndarray):
        self.n, self.last, self.top = n, np.frombuffer(last, np.int32).astype(np.int64), np.frombuffer(top, np.int32).astype(np.int64)
        self.at, self.data, self.m = np.frombuffer(at, np.int32), np.frombuffer(data, np.uint8), m
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and their impacts."""
        if b not in self.open:
            values = from_bytes(self.data[self.at[b] : self.at[b + 1] if b + 1 < len(self.at) else len(self.data)])
            half = len(values) // 2
            doc = np.cumsum(values[:half])
            self.open[b] = doc, impacts(values[half:], self.m[doc])
        return self.open[b]


def search_shard(terms: list[tuple[Postings, int]], n_docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, documents) of the k best documents of a shard for an item that score at least `floor`; ties to the lower document."""
    scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
    if not terms:
        return scores, found
    first, last, top, of, block = [], [], [], [], []
    for i, (p, w) in enumerate(terms):
        if len(p.last) == 1:
            doc, impact = p.block(0)
            first, last, top = [*first, doc], [*last, doc], [*top, w * impact]
            block.append(np.zeros(len(doc), np.int64))
        else:
            first, last, top = [*first, np.concatenate(([0], p.last[:-1] + 1))], [*last, p.last], [*top, w * p.top]
            block.append(np.arange(len(p.last)))
        of.append(np.full(len(block[-1]), i))
    first, last, top, of, block = (np.concatenate(x) for x in (first, last, top, of, block))
    # Shallow pointers: what they point at changes at borders only, from one stretch of documents to the next.
    borders = np.unique(np.concatenate((first, last + 1)))
    step = np.zeros(len(borders), np.int64)
    np.add.at(step, np.searchsorted(borders, first), top)
    np.add.at(step, np.searchsorted(borders, last + 1), -top)
    bound = np.cumsum(step)[:-1]
    keys, base = (of << 32) | last, np.arange(len(terms)) << 32
    ends = np.searchsorted(of, np.arange(len(terms)), "right")
    total, at, least = np.zeros(n_docs, np.int64), 0, max(1, floor)
    while at < len(bound):
        pivots = at + np.flatnonzero(bound[at:] >= least)[:RUN]
        if not len(pivots):
            break
        at = int(pivots[-1]) + 1
        start, end = borders[pivots], borders[pivots + 1] - 1
        pointer = np.searchsorted(keys, base[:, None] | start[None, :])
        there = pointer < ends[:, None]
        there[there] = (first[pointer[there]].reshape(-1) <= np.broadcast_to(end, there.shape)[there])
        touched = np.unique((of[pointer[there]] << 32) | block[pointer[there]])
        seen = []
        for i, b in zip((touched >> 32).tolist(), (touched & (2**32 - 1)).tolist(), strict=True):
            doc, impact = terms[i][0].block(b)
            place = np.searchsorted(start, doc, "right") - 1
            inside = (place >= 0) & (doc <= end[place])
            total[doc[inside]] += terms[i][1] * impact[inside]
            seen.append(doc[inside])
        seen = np.unique(np.concatenate(seen)) if seen else np.empty(0, np.int64)
        good = seen[total[seen] >= least]
        scores, found = np.concatenate((scores, total[good])), np.concatenate((found, good))
        total[seen] = 0
        order = np.lexsort((found, -scores))[:k]
        scores, found = scores[order], found[order]
        if len(scores) == k:
            least = max(least, int(scores[-1]))
    return scores, found


def search(table: DataFrame, n_docs: int, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", k: int = 20) -> DataFrame:
    """(item, rank, key, score): the k documents of the index that score highest for each item, only those above 0.

    Equal scores go to the smaller key, rows without one last (a key of 2 ** 63 - 1 is read as none). Items with null or empty
    texts have no rows; a repeated item has its rows for each time. Other columns are ignored.
    """
    spark = table.sparkSession
    small_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, i, words = [], [], []
            for x, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                more = terms_of(t)
                q, i, words = q + [x] * len(more), i + [y] * len(more), words + more
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, b.column(1).type), pa.array(words, pa.binary())], names=["q", "item", "term"])

    kind = items.schema[item].dataType.simpleString()
    asked = written(items.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(text).alias("text")), "items")
    groups = max(1, -(-asked.count() // ITEMS))
    words = asked.mapInArrow(split, f"q long, item {kind}, term binary").groupBy("q", "term").agg(F.count("*").alias("n"))
    words = words.groupBy(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("g"), "term").agg(F.collect_list(F.struct("q", "n")).alias("in"))  # ITEMS or so in each
    words = written(words, "terms")
    distinct = words.select("term").distinct()
    few = words.count() <= BROADCAST_CELLS
    near = F.broadcast if few else (lambda df: df)
    df = table.select("term", "n").join(near(distinct), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(words.join(df, "term").select("g", "term", "in", weight.alias("w")).where("w > 0"), "weights")
    lists = table.join(near(weighted), "term").select("shard", "g", "n", "last", "top", "at", "data", "w", F.col("in.q").alias("q"), F.col("in.n").alias("c"))
    none = F.array().cast("array<long>")
    every = table.where("term IS NULL").select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "n", "last", "top", "at", "data", F.lit(0).cast("long").alias("w"), none.alias("q"), none.alias("c"))
    met = lists.unionByName(every).repartition(partitions(spark), "shard", "g").sortWithinPartitions("g", "shard")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of a group's items: their highest scores in the shards so far
        group, now, rows = None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            shard = next((r for r in rows if not r[5]), None)  # the documents: weight 0
            if shard is None or len(rows) < 2:
                return
            doc_keys, m = np.frombuffer(shard[3], np.int64), np.frombuffer(shard[4], np.int64)
            asked: defaultdict[int, list] = defaultdict(list)
            for *lists, w, qs, cs in (r for r in rows if r[5]):
                postings = Postings(*lists, m)
                for q, c in zip(qs, cs, strict=True):
                    asked[q].append((postings, w * c))
            out = []
            for q, terms in asked.items():
                held = best.get(q, np.empty(0, np.int64))
                scores, docs = search_shard(terms, len(m), k, int(held[k - 1]) if len(held) >= k else 1)
                best[q] = -np.sort(-np.concatenate((held, scores)))[:k]
                out.append((np.full(len(docs), q), scores, doc_keys[docs]))
            q, scores, found = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(scores), pa.array(found, mask=found == NO_KEY)], names=["q", "score", "k"])

        for b in batches:
            for s, g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (g, s):
                    yield from flush()
                    rows.clear()
                    if group != g:
                        best.clear()
                    group, now = g, (g, s)
                rows.append(row)
        yield from flush()

    found = met.mapInArrow(ranked, "q long, score long, k long")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("k").asc_nulls_last()))).where(F.col("rank") <= k)
    return found.join(F.broadcast(asked.select("q", "item")) if few else asked.select("q", "item"), "q").select(F.col("item").alias(item), "rank", F.col("k").alias(key), "score")
