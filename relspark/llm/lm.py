"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

Documents are gathered into batches as they stand in their input partitions, and dealt compressed. A batch explodes into
its n-grams, counts them, and sends each hash bucket a sorted block of hashes and counts (delta-coded: about six bytes an
n-gram, where a row of its own would take forty). A bucket joins the blocks of all batches into its part of the count
table and answers each block in its own order; a batch then joins the answers to its n-grams and sums the scores per
document. N-grams frequent everywhere come once from each batch, so no bucket is hot. Hashes have 64 bits. Should a lost
executor's input come back in another order, so that a batch has other texts than those counted, the task fails.

With c(g) the occurrences of g in all other rows, N their words, the score of a word is c(uvw) / c(uv) if c(uvw) > 0,
else BACKOFF * c(vw) / c(v) if c(vw) > 0, else BACKOFF ** 2 * max(c(w), UNSEEN) / max(N, 1); a text's first words have
no longer n-grams and start with the longest that they have, without a factor.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, partitions, small_batches
from .substring import WORDS, mix

BACKOFF = 0.4
UNSEEN = 0.5
BATCH_BYTES = 8_000_000
BUCKET_GRAMS = 4_000_000

SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
seq AS (SELECT doc_id, i, word AS w, lag(word) OVER d AS v, lag(word, 2) OVER d AS u FROM one WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM seq GROUP BY ALL), d1 AS (SELECT doc_id, w, count(*) AS n FROM seq GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS n FROM seq WHERE v IS NOT NULL GROUP BY ALL), d2 AS (SELECT doc_id, v, w, count(*) AS n FROM seq WHERE v IS NOT NULL GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS n FROM seq WHERE u IS NOT NULL GROUP BY ALL), d3 AS (SELECT doc_id, u, v, w, count(*) AS n FROM seq WHERE u IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS n FROM seq), own AS (SELECT doc_id, len(w) AS n FROM words),
counts AS (
  SELECT s.doc_id, s.i, coalesce(c3.n - d3.n, 0) AS uvw, coalesce(cuv.n - duv.n, 0) AS uv, coalesce(c2.n - d2.n, 0) AS vw,
    coalesce(cv.n - dv.n, 0) AS v, c1.n - d1.n AS w, greatest(total.n - own.n, 1) AS rest
  FROM seq s CROSS JOIN total JOIN own USING (doc_id)
  JOIN c1 ON c1.w = s.w JOIN d1 ON d1.doc_id = s.doc_id AND d1.w = s.w
  LEFT JOIN c1 cv ON cv.w = s.v LEFT JOIN d1 dv ON dv.doc_id = s.doc_id AND dv.w = s.v
  LEFT JOIN c2 ON c2.v = s.v AND c2.w = s.w LEFT JOIN d2 ON d2.doc_id = s.doc_id AND d2.v = s.v AND d2.w = s.w
  LEFT JOIN c2 cuv ON cuv.v = s.u AND cuv.w = s.v LEFT JOIN d2 duv ON duv.doc_id = s.doc_id AND duv.v = s.u AND duv.w = s.v
  LEFT JOIN c3 ON c3.u = s.u AND c3.v = s.v AND c3.w = s.w LEFT JOIN d3 ON d3.doc_id = s.doc_id AND d3.u = s.u AND d3.v = s.v AND d3.w = s.w),
scores AS (
  SELECT doc_id, CASE WHEN uvw > 0 THEN 3 WHEN vw > 0 THEN 2 ELSE 1 END AS used,
    CASE WHEN uvw > 0 THEN ln(uvw / uv) WHEN vw > 0 THEN ln(vw / v) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
      ELSE ln(greatest(w, 0.5) / rest) + least(i - 1, 2) * ln(0.4) END AS s
  FROM counts)
SELECT own.doc_id, own.n AS n_words, count(*) FILTER (WHERE used = 3) AS n_trigrams, count(*) FILTER (WHERE used = 2) AS n_bigrams,
  round(coalesce(sum(s), 0.0), 4) AS log_score
FROM own LEFT JOIN scores USING (doc_id) GROUP BY own.doc_id, own.n
"""


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of x, and the place in them of each value of x."""
    order = np.argsort(x)
    x = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    place = np.empty(len(x), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], place


class Grams:
    """N-grams of a batch of texts: uniq are the sorted hashes, index the places in it of all, order after order."""

    def __init__(self, texts: Iterator[bytes | None], bits: int = 64) -> None:
        self.bits = bits
        parts = []
        for t in texts:  # one text's words at a time
            words = (t or b"").split()
            parts.append(np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words)))
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        w = np.concatenate([np.zeros(0, np.uint64), *parts])
        del parts
        n = len(w)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        two, three = np.flatnonzero(self.place >= 1), np.flatnonzero(self.place >= 2)
        self.ends = [np.arange(n), two, three]
        a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
        grams = np.empty(n + len(two) + len(three), np.uint64)
        grams[:n] = mix(w ^ c)
        grams[n : n + len(two)] = mix(w[two - 1] * a + mix(w[two] + b))
        grams[n + len(two) :] = mix(w[three - 2] * a + mix(w[three - 1] * c + mix(w[three] + b)))
        grams >>= np.uint64(64 - bits)
        self.uniq, index = ranked(grams)
        self.index = np.split(index, [n, n + len(two)])

    def counts(self) -> np.ndarray:
        return sum(np.bincount(i, minlength=len(self.uniq)) for i in self.index)

    def buckets(self, n: int) -> np.ndarray:
        """Borders of the buckets in uniq: a bucket is a range of hashes."""
        of = (self.uniq >> np.uint64(self.bits - 32)) * np.uint64(n) >> np.uint64(32)
        return np.searchsorted(of, np.arange(n + 1, dtype=np.uint64))

    def scores(self, totals: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
        """Sum of logarithms, trigrams used and bigrams used, by text. totals: counts of uniq in all texts."""
        n, docs = len(self.doc), len(self.sizes)
        other = []
        for index, end in zip(self.index, self.ends, strict=True):
            _, cell, own = np.unique(index * np.int64(docs) + self.doc[end], return_inverse=True, return_counts=True)
            full = np.zeros(n, np.int64)
            full[end] = totals[index].astype(np.int64) - own[cell]
            other.append(full)
        w, vw, uvw = other
        v, uv = np.concatenate(([0], w[:-1])) if n else w, np.concatenate(([0], vw[:-1])) if n else vw
        rest = np.maximum(words - self.sizes, 1)[self.doc]
        back = math.log(BACKOFF)
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.log(np.maximum(w, UNSEEN) / rest) + np.minimum(self.place, 2) * back
            two = np.log(vw / v) + (self.place >= 2) * back
            s = np.where(uvw > 0, np.log(uvw / uv), np.where(vw > 0, two, one))
        by = lambda x: np.bincount(self.doc, x, docs)
        return by(s), by(uvw > 0).astype(np.int64), by((uvw <= 0) & (vw > 0)).astype(np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_trigrams, n_bigrams, log_score) of each row: words, those scored by trigrams and by bigrams,
    and the sum of their natural logarithms. Null and empty texts have no words and score 0. Repeated rows are other
    rows to each other. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    words = docs.agg(F.sum(F.size(F.array_remove(F.split("t", WORD_SEPARATORS, -1), "")))).first()[0] or 0
    buckets = max(1, math.ceil(3 * words / BUCKET_GRAMS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def whole() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for b in held:
                    out.write_batch(b)
            data = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
            return pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()), "mark": pa.array([zlib.crc32(data)], pa.int64()), "texts": pa.array([data], pa.binary())})

        for b in batches:
            if held and size + b.nbytes > BATCH_BYTES:
                yield whole()
                number, held, size = number + 1, [], 0
            held.append(b)
            size += b.nbytes
        if held:
            yield whole()

    def texts(data: pa.Scalar) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data.as_buffer())).read_all()

    def grams(t: pa.Table) -> Grams:
        return Grams(x.as_py() for x in t.column("t").cast(pa.binary()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, mark, data in zip(*(b.column(c) for c in ("batch", "mark", "texts")), strict=True):
                g = grams(texts(data))
                edge, counts = g.buckets(buckets), g.counts()
                used = np.flatnonzero(np.diff(edge))
                rows = [(squeeze(np.diff(g.uniq[edge[u] : edge[u + 1]], prepend=np.uint64(0))), squeeze(counts[edge[u] : edge[u + 1]])) for u in used]
                n = len(used)
                del g, counts
                blocks = [pa.array([r[i] for r in rows], pa.binary()) for i in range(2)]
                names = ["bucket", "batch", "mark", "hashes", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array([x.as_py()] * n, pa.int64()) for x in (batch, mark)), *blocks], names=names)

    def answer(t: pa.Table) -> pa.Table:
        blocks = [np.cumsum(expand(x.as_py()), dtype=np.uint64) for x in t.column("hashes")]
        edges = np.cumsum([len(b) for b in blocks])[:-1]
        _, index = ranked(np.concatenate(blocks))
        del blocks
        totals = np.bincount(index, np.concatenate([expand(x.as_py()) for x in t.column("counts")]))[index]
        parts = [squeeze(p.astype(np.uint64)) for p in np.split(totals, edges)]
        return t.select(["batch", "mark", "bucket"]).append_column("totals", pa.array(parts, pa.binary()))

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        if len(left) != 1 or set(right.column("mark").to_pylist()) - {left.column("mark")[0].as_py()}:
            raise RuntimeError("a batch came back with other texts than those counted")
        own = texts(left.column("texts")[0])
        g = grams(own)
        order = np.argsort(right.column("bucket").to_numpy())
        got = right.column("totals")
        totals = np.concatenate([np.zeros(0, np.uint64), *(expand(got[int(i)].as_py()) for i in order)])
        s, three, two = g.scores(totals, words)
        return pa.Table.from_arrays([own.column("k"), *map(pa.array, (g.sizes, three, two, s))], names=["k", "n_words", "n_trigrams", "n_bigrams", "log_score"])

    # Asking and scoring are one query that deals the texts once.
    gathered = docs.mapInArrow(gather, "batch long, mark long, texts binary").repartition(partitions(docs.sparkSession), "batch")
    asked = gathered.mapInArrow(ask, "bucket int, batch long, mark long, hashes binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "batch long, mark long, bucket int, totals binary")
    out = gathered.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(total, f"k {kind}, n_words long, n_trigrams long, n_bigrams long, log_score double")
    return out.withColumnRenamed("k", key)
