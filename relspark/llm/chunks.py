"""Token ids of whole texts by way of chunks that a tokenizer treats alike wherever they stand.

The pre-tokenizers used here never match across "non-space, space": a match that holds a space starts with it, or is a
run of white space. So a text may be cut before each single space that stands between two non-spaces. Chunks repeat,
and their ids are kept in a table of bounded size. When it is full, only what was used again since the last time stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable

KEPT = 800_000
#: Marks the key of a text's first chunk.
FIRST = "\x00"
#: A space next to more white space. Python's regular expressions and str.isspace() know more white space than Unicode does.
EDGE = re.compile(r" \s|\s ").search


class Kept(dict):
    """Values by key, at most about `most` of them; need() says what is missing and lets go of what was used once."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.again, self.calls = most, set(), 0

    def need(self, keys: set) -> set:
        new = keys.difference(self)
        if len(self) + len(new) > self.most:
            again, self.again = self.again, set()
            stay = {k: self[k] for k in again}
            self.clear()
            if len(stay) + len(keys) <= self.most:
                self.update(stay)
            new = keys.difference(self)
        self.calls += 1
        if self.calls % 4 == 0:  # often enough to see what is frequent
            self.again |= keys - new
        return new


class Chunks:
    """encode: list of chunks -> list of little-endian uint32 id bytes.

    parts: text -> keys of its chunks, by default as cut() has them. A key is a chunk without the space that begins it;
    a text's first chunk has none, and its key begins with FIRST.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT, parts: Callable[[str], list[str]] | None = None) -> None:
        self.encode, self.ids, self.parts = encode, Kept(kept), parts or self.keys

    @staticmethod
    def chunk(key: str) -> str:
        return key[1:] if key[0] == FIRST else " " + key

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the chunks of a text; the chunks join to it."""
        first, *rest = text.split(" ")
        out, now, open_end = [], FIRST + first, not first or first[-1].isspace()
        for p in rest:
            if open_end or not p or p[0].isspace() or p[0] == FIRST:
                now += " " + p
                open_end = True if not p else p[-1].isspace()
            else:
                out.append(now)
                now = p
                open_end = p[-1].isspace()
        out.append(now)
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is empty. Texts are taken in groups of about 4 million characters."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= 4_000_000:
                out += self._some(group)
                group, size = [], 0
        return out + self._some(group) if group else out

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) if t else [] for t in texts]
        new = list(self.ids.need(set().union(*split)))
        self.ids.update(zip(new, self.encode(new), strict=True))
        get = self.ids.__getitem__
        return [b"".join(map(get, parts)) for parts in split]

    def keys(self, text: str) -> list[str]:
        if text[0] == " " or text[-1] == " " or FIRST in text or EDGE(text):
            return self.cut(text)
        out = text.split(" ")
        out[0] = FIRST + out[0]
        return out
