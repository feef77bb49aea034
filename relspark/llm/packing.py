"""Sequences of fixed length from documents in the order of a Hilbert curve.

Each document's hashed token counts are projected to a few dimensions, and its point's place on a Hilbert curve is its
sort key. Documents are range-sorted by that key; each range cuts its stream of ids every `length` ids. What is left
at the end of a range goes into sequences whose lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hf
from .common import ranges, small_batches, written

DIMENSIONS = 4
BITS = 12
#: Spread of a projected document: the mean of many values in [-1, 1] is near 0.
SPREAD = 6.0


def projection(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A value in [-1, 1) for each id and dimension, from a hash of both."""
    x = np.arange(size * dimensions, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return (x.astype(np.float64) / 2.0**63 - 1).astype(np.float32).reshape(size, dimensions)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of points (n, d) with coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of the larger cubes
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents; one without ids stands at the middle of the cube."""
    means, sizes = np.zeros((len(ids), table.shape[1])), np.array([len(x) for x in ids])
    some = np.flatnonzero(sizes)
    if len(some):
        every = np.concatenate([ids[i] for i in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        means[some] = np.stack([np.add.reduceat(np.take(column, every), starts, dtype=np.float64) for column in table.T], axis=1) / sizes[some][:, None]
    points = ((np.tanh(means * SPREAD) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(points, 0, (1 << BITS) - 1))


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, ids binary, doc_tokens, sequence_id, offset): each id of each row lies in exactly one.

    ids are little-endian uint32. Null and empty texts are the end id alone (no piece without one). Repeated rows are
    documents of their own; other columns are ignored. Sequences of a range are numbered from its own base, filled
    from offset 0 without gaps to `length`, the last ones of a range to powers of two.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width, kind = hf.width(tokenizer), docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, end, table = hf.text_encoder(tokenizer), b"" if end_id is None else np.array([end_id], "<u4").tobytes(), None
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            ids = [np.frombuffer(x + end, "<u4") for x in encoded(b.column(1).to_pylist())]
            table = np.asfortranarray(projection(1 << (8 * width if width == 2 else 20))) if table is None else table
            place = keys([x % len(table) for x in ids] if width > 2 else ids, table)
            data = [squeeze(x.astype(f"<u{width}").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place), pa.array(data, pa.binary())], names=[key, "place", "data"])

    coded = written(docs.select(key, F.col(text).cast("string")).mapInArrow(encode, f"`{key}` {kind}, place long, data binary"), "coded")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        base = TaskContext.get().partitionId() << 40
        sequence, used, rows, size = base, 0, [], 0
        tail: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        key_type = pa.int64()
        for b in batches:
            key_type = b.schema.types[0]
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(expand(data), f"<u{width}").astype("<u4").tobytes()
                n, at = len(ids) // 4, 0
                size += n
                while at < n:
                    take = min(n - at, length - used)
                    tail.append((k, at, take, ids[4 * at : 4 * (at + take)], n, sequence, used))
                    at, used = at + take, used + take
                    if used == length:
                        rows += tail
                        tail, sequence, used = [], sequence + 1, 0
            if size > 1 << 20:
                yield batch()
                rows, size = [], 0
        at, room = 0, 0  # the ids of the last sequence go to the powers of two that make up their number
        left = used
        for k, start, n, ids, whole, _, _ in tail:
            done = 0
            while done < n:
                if not room:
                    room = 1 << (left.bit_length() - 1)
                    at = 0
                take = min(n - done, room)
                rows.append((k, start + done, take, ids[4 * done : 4 * (done + take)], whole, sequence, at))
                done, room, at, left = done + take, room - take, at + take, left - take
                if not room:
                    sequence += 1
        yield batch()

    n = ranges(coded)
    ordered = coded.repartitionByRange(n, "place", key).sortWithinPartitions("place", key).select(key, "data")
    return ordered.mapInArrow(cut, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
