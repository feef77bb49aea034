"""Token ids in length-delimited binary record files with a separate offset index.

File: 16-byte header (magic, id width), then frames: length (8 bytes), its masked CRC-32 (4), payload, the payload's
masked CRC-32 (4); all little-endian. A payload is a byte that says whether there is a key, the document's key (8 bytes) and its ids. The index beside it holds
the offset of each frame and the end of the last, with a masked CRC-32, so that any record is read by one seek.
A partition writes under a name of its attempt and renames at the end: a task that runs again replaces its file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hf
from .common import ranges, small_batches

MAGIC = b"RSPKREC1"
HEADER = len(MAGIC) + 8


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checksums of checksums stay apart."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload; None at the end. Raises on a wrong length or checksum."""
    if not (head := stream.read(12)):
        return None
    size, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("a frame's length fails its checksum")
    body = stream.read(size + 4)
    if len(body) != size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
        raise ValueError("a frame's payload fails its checksum")
    return body[:size]


class RecordFile:
    """Random access by record number through the index."""

    def __init__(self, uri: str) -> None:
        where, path = pafs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        head = self.file.read(HEADER)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a record file")
        self.width = head[len(MAGIC)]
        with where.open_input_stream(path.removesuffix(".rec") + ".idx") as f:
            data = f.read()
        if masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the index fails its checksum")
        self.offsets = np.frombuffer(data[:-4], dtype="<u8")

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        """(key, ids) of record i."""
        self.file.seek(int(self.offsets[i]))
        return parse(read_frame(self.file), self.width)

    def close(self) -> None:
        self.file.close()


def parse(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    known, key = struct.unpack_from("<?q", payload)
    return key if known else None, np.frombuffer(payload, f"<u{width}", offset=9)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Encodes whole texts and writes them in ascending order of the key, a file for each range of keys.

    Null and empty texts are records with the end id only. Rows of one key stand together in an order that depends
    on their texts alone; those without a key come first. Returns (uri, records, ids) by file, in order: bounded by the number
    of files, not of documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = hf.width(tokenizer)
    where, path = pafs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, path = pafs.FileSystem.from_uri(folder)
        where.create_dir(path, recursive=True)
        name = f"{path}/part-{task.partitionId():06d}"
        own = f"{name}.{task.taskAttemptId()}"
        end = b"" if end_id is None else struct.pack("<I", end_id)
        chunks, at, total, offsets = hf.encoder(tokenizer), HEADER, 0, []
        with where.open_output_stream(f"{own}.rec") as out:
            out.write(MAGIC + bytes([width]) + bytes(7))
            for b in batches:
                for k, ids in zip(b.column(0).to_pylist(), chunks(b.column(1).to_pylist()), strict=True):
                    every = np.frombuffer(ids + end, "<u4")
                    data = frame(struct.pack("<?q", k is not None, k or 0) + every.astype(f"<u{width}").tobytes())
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
                    total += len(every)
        index = np.array([*offsets, at], "<u8").tobytes()
        with where.open_output_stream(f"{own}.idx") as out:
            out.write(index + struct.pack("<I", masked(index)))
        for kind in ("idx", "rec"):
            where.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "records": [len(offsets)], "ids": [total]})

    n = ranges(docs)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.repartitionByRange(n, F.col("k"), F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    files = rows.mapInArrow(run, "part int, records long, ids long").collect()
    return [(f"{folder}/part-{r.part:06d}.rec", r.records, r.ids) for r in sorted(files)]


def read(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """(key, start, ids binary) of every record, checked; start counts the ids of all records before it."""
    starts = [0, *accumulate(n for _, _, n in files)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                where, path = pafs.FileSystem.from_uri(files[i][0])
                with where.open_input_stream(path, buffer_size=1 << 20) as f:
                    head = f.read(HEADER)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError("not a record file")
                    width, at, size, rows = head[len(MAGIC)], starts[i], 0, []
                    while (payload := read_frame(f)) is not None:
                        k, ids = parse(payload, width)
                        rows.append((k, at, ids.astype("<u4").tobytes()))
                        at += len(ids)
                        size += len(ids)
                        if size > 1 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                    yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        k, s, ids = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "ids"])

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "key long, start long, ids binary")
