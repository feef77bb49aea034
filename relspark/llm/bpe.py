"""Byte-level BPE: encoding by a lazily determinised transducer, decoding through a UTF-8 state machine.

A token sequence is the BPE encoding of its bytes exactly if each adjacent pair of tokens is the encoding of its own
bytes (no merge of the whole crosses a token end, and a first merge that did would also happen in that pair alone).
That makes encoding regular: a hypothesis is the last finished token and the bytes of the token begun since. The
transducer reads bytes and follows all hypotheses at once; a state is their set, together with the tokens on which
they still differ. Tokens leave as soon as all hypotheses agree on them, which is at most one longest token later.
States and transitions are made when first met, and dropped together when there are too many.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hf
from .chunks import Chunks, Kept
from .common import small_batches


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """A state is a dictionary from byte to (next state, tokens that leave), filled as bytes are met."""

    NONE = 1 << 60

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000) -> None:
        self.ranks, self.most = ranks, most
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.begun = {k[:i] for k in ranks for i in range(1, len(k))}
        self.single = [bytes((b,)) for b in range(256)]
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple | None] = {}
        self.reset()

    def reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self.made = 0
        self.start = self._intern(((-1, b"", ()),))
        if len(self.fits) > self.most:
            self.fits.clear()

    def _intern(self, state: tuple) -> int:
        n = self.number.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
            self.moves.append({})
        return n

    def merge(self, data: bytes, steps: list | None = None) -> list[bytes]:
        """Plain merging by least rank, used for tokens only. steps: gets rank, first and last part at each merge."""
        get, none = self.ranks.get, self.NONE
        parts = [self.single[b] for b in data]
        best = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while best and (least := min(best)) != none:
            i = best.index(least)
            parts[i] += parts.pop(i + 1)
            del best[i]
            if i < len(best):
                best[i] = get(parts[i] + parts[i + 1], none)
            if i:
                best[i - 1] = get(parts[i - 1] + parts[i], none)
            if steps is not None:
                steps.append((least, parts[0], parts[-1]))
        return parts

    def _spine(self, token: int) -> tuple | None:
        """Merges that make a token: rank and first part, rank and last part; None if merging makes something else."""
        if token not in self.spines:
            steps: list = []
            data = self.bytes_of[token]
            whole = len(self.merge(data, steps)) == 1
            self.spines[token] = ([(r, a) for r, a, _ in steps], [(r, z) for r, _, z in steps], data[:1], data[-1:]) if whole else None
        return self.spines[token]

    def _stands(self, last: int, token: int) -> bool:
        """Whether token is its own encoding and may follow last (-1: the start).

        Both tokens' merges run in the order of their ranks, the left one's first at the same rank; the pair stands
        if at no time the part that ends the one and the part that begins the other would merge before.
        """
        if last < 0:
            return self._spine(token) is not None
        if (ok := self.fits.get((last, token))) is None:
            ok = self.fits[last, token] = self._meet(self._spine(last), self._spine(token))
        return ok

    def _meet(self, left: tuple | None, right: tuple | None) -> bool:
        if left is None or right is None:
            return False
        get, none = self.ranks.get, self.NONE
        (_, a, _, x), (b, _, y, _) = left, right
        i, j, m, n = 0, 0, len(a), len(b)
        across = get(x + y, none)
        while i < m or j < n:
            p = a[i][0] if i < m else none
            q = b[j][0] if j < n else none
            if p <= q:
                if across < p:
                    return False
                x = a[i][1]
                i += 1
            else:
                if across <= q:
                    return False
                y = b[j][1]
                j += 1
            across = get(x + y, none)
        return across == none

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        grown, done, begun_by, rank, one = [], None, self.begun, self.ranks.get, self.single[byte]
        for last, begun, waiting in self.states[state]:
            now = begun + one
            if done is None and (t := rank(now)) is not None and self._stands(last, t):
                done = (t, b"", (*waiting, t))
            if now in begun_by:
                grown.append((last, now, waiting))
        if done:
            grown.append(done)
        if not grown:
            raise ValueError(f"byte {byte} has no token")
        first, out = grown[0][2], 0
        if first:
            shortest = min([len(h[2]) for h in grown])
            while out < shortest and all([h[2][out] == first[out] for h in grown]):
                out += 1
        move = (self._intern(tuple([(a, b, w[out:]) for a, b, w in grown] if out else grown)), first[:out])
        self.moves[state][byte] = move
        self.made += 1
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; a piece that is a token by itself is that token."""
        if (t := self.ranks.get(piece)) is not None:
            return [t]
        if self.made > self.most:
            self.reset()
        state, ids, moves = self.start, [], self.moves
        for byte in piece:
            move = moves[state].get(byte) or self._move(state, byte)
            state, out = move
            if out:
                ids += out
        for _, begun, waiting in self.states[state]:
            if not begun:
                return ids + list(waiting)
        raise ValueError("bytes without an encoding")


#: Next state of the UTF-8 machine by state and byte class; 0 between characters, 8 after an error.
#: States: 1-3 continuation bytes to come; 4 after E0, 5 after ED, 6 after F0, 7 after F4.
def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), 8, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE0:0xF0] = 2
    t[0, 0xF0:0xF5] = 3
    for byte, state in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        t[0, byte] = state
    for state, low, high, to in ((1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1), (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)):
        t[state, low:high] = to
    return t


class Decoder:
    """Bytes of ids, given out up to the last whole character; feed() may be called with any cuts between ids."""

    UTF8 = _utf8_table()

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        size = max(bytes_of) + 1
        self.after = np.repeat(np.arange(9, dtype=np.uint8)[:, None], size, axis=1)
        for i in range(max(map(len, bytes_of.values()))):
            at = np.array([t for t, b in bytes_of.items() if len(b) > i])
            self.after[:, at] = self.UTF8[self.after[:, at], np.array([bytes_of[t][i] for t in at.tolist()])]
        self.clear()

    def clear(self) -> None:
        self.state, self.held, self.valid = 0, b"", True

    def feed(self, ids: np.ndarray) -> bytes:
        """The whole characters that are known now. Bytes that can't be UTF-8 pass unchanged and clear `valid`."""
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        closed = self.after[0, ids] == 0
        if self.state == 0 and closed.all():
            self.held = b""
            return data
        state, i, n = self.state, 0, len(ids)
        odd = np.flatnonzero(~closed)
        while i < n:
            if state == 0:
                k = np.searchsorted(odd, i)
                if k == len(odd):
                    break
                i = int(odd[k])
            state = int(self.after[state, ids[i]])
            if state == 8:
                self.valid, state = False, 0
            i += 1
        self.state = state
        cut = len(data)
        while state and cut and data[cut - 1] & 0xC0 == 0x80:
            cut -= 1
        cut -= bool(state and cut)
        self.held = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        """What is held at the end; an unfinished character clears `valid`."""
        held, self.valid = self.held, self.valid and not self.held
        self.held, self.state = b"", 0
        return held


def little_endian(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    data = array("I", ids)
    if data.itemsize != 4 or sys.byteorder != "little":
        return np.array(ids, dtype="<u4").tobytes()
    return data.tobytes()


@lru_cache(2)
def codec(path: str, pattern: str) -> tuple[Chunks, Transducer, Decoder]:
    """Encoder and decoder of a rank file, once for each worker."""
    machine = Transducer(read_ranks(path))
    split = regex.compile(pattern).findall
    known, usual = Kept(150_000), pattern == hf.BYTE_SPLIT

    def encode(keys: list[str]) -> list[bytes]:
        pieces = [hf.pieces_of(k, " ", split) for k in keys] if usual else [split(Chunks.chunk(k)) for k in keys]
        for p in known.need(set().union(*pieces)):
            known[p] = little_endian(machine.encode(p.encode()))
        get = known.__getitem__
        return [get(ps[0]) if len(ps) == 1 else b"".join([get(p) for p in ps]) for ps in pieces]

    return Chunks(encode), machine, Decoder(machine.bytes_of)


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary) of each row: little-endian uint32 ids. Null and empty texts have none; other columns are ignored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = codec(path, pattern)[0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chunks(b.column(1).to_pylist()), pa.binary())], names=[key, "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def decode_bytes(ids: bytes, decoder: Decoder, step: int = 1 << 16) -> Iterator[bytes]:
    """Decoded bytes of little-endian uint32 ids, whole characters at a time."""
    decoder.clear()
    every = np.frombuffer(ids, dtype="<u4")
    for at in range(0, len(every), step):
        yield decoder.feed(every[at : at + step])
    yield decoder.close()


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row, encoded and decoded again in one pass over the texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, _, decoder = codec(path, pattern)
        for b in batches:
            ids = chunks(b.column(1).to_pylist())
            back = []
            for x in ids:
                digest = hashlib.sha256()
                for part in decode_bytes(x, decoder):
                    digest.update(part)
                back.append(digest.hexdigest())
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
