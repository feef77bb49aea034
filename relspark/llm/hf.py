"""The tokenizers library over chunks, one encoder a worker.

The library's model merges; what comes before it (normal form, lower case, splitting, byte alphabet) costs the library
more than the merging, so for two known layouts it is done here for chunks of plain Latin text, and each distinct
pre-token goes to the model once. Any other chunk, and any other layout, goes through the library as a whole.

A byte-level vocabulary whose merges make tokens in ascending order of their ids, each token being what its own bytes
merge to, is a table of ranks: plain texts then go through tiktoken, which gives the same ids (tested) several times as fast.
So do the words of a vocabulary that marks their ends.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .chunks import FIRST, Chunks, Kept

if TYPE_CHECKING:
    from tokenizers import Tokenizer

KEPT = 400_000
CALL = 20_000
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[int, str]:
    """The printable character of each byte: itself where printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


def known_layout(layout: dict) -> tuple[str, Callable[[str], list[str]] | None]:
    """"bytes" or "words" and how they split a plain chunk before the byte alphabet, as the library does; else "" and None.

    "words" lowers its text and drops white space, so that white space cuts it into chunks.
    """
    pre, norm = layout["pre_tokenizer"] or {}, layout["normalizer"]
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "bytes", regex.compile(BYTE_SPLIT).findall
    steps = [p["type"] for p in pre.get("pretokenizers", [])]
    if steps == ["Split", "ByteLevel"] and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        split, level = pre["pretokenizers"]
        white = norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        if white and split["invert"] and split["behavior"] == "Removed" and not level["use_regex"] and not level["add_prefix_space"]:
            return "words", regex.compile(split["pattern"]["Regex"]).findall
    return "", None


FOREIGN = re.compile("[^\x00-\u024f]").search
#: Marks the key of a whole text that isn't plain; plain texts hold no such character.
WHOLE = "\x01"
STOPS = frozenset(".,;:!?")
#: Stands after a word whose end the vocabulary marks; words hold no white space.
MARK = b"\n"


def is_plain(text: str) -> bool:
    """Printable text (and line ends) of Latin letters in normal form, for which lower case and classes are beyond doubt."""
    return text.replace("\n", "").isprintable() and (text.isascii() or not FOREIGN(text) and unicodedata.is_normalized("NFC", text))


def pieces_of(key: str, space: str, split: Callable[[str], list[str]]) -> list[str]:
    """Pre-tokens of a plain chunk, the usual ones (a word, a word and a stop) without the splitting pattern."""
    if key[0] == FIRST:
        key, space = key[1:], ""
    if key.isalpha():
        return [space + key]
    if key[-1:] in STOPS and key[:-1].isalpha():
        return [space + key[:-1], key[-1]]
    return split(space + key)


def library(path: str) -> Tokenizer:
    """The tokenizer; strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    whole.no_truncation()
    whole.no_padding()
    return whole


def by_library(whole: Tokenizer, texts: list[str]) -> list[bytes]:
    out = []
    for at in range(0, len(texts), 4096):
        out += [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
    return out


def ranks(layout: dict, whole: Tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if merging by rank is sure to give the same ids; else None.

    A vocabulary that marks the ends of words has MARK as the last byte of such tokens, and MARK after each word to be encoded:
    no word holds it, and the ids of marked bytes are below all merges, so that it joins the last byte first.

    Merging by rank takes the leftmost pair whose joined bytes are the lowest token, the library the leftmost pair whose
    listed merge is lowest. Merges make tokens in ascending order of ids, each once, so both orders are the same, and
    the ways can part only where a pair x, y joins to a token t whose listed merge is another pair. Then all merges so far inside
    t's span, which end at its borders, are those that t alone would see, in the same order; so the library, given t
    alone, also arrives at x, y, and can't join it. That each token alone merges to itself is checked here, so no such pair
    exists, in words of any length.
    """
    from tokenizers import Tokenizer, models

    model, kind = layout["model"], known_layout(layout)[0]
    end = model.get("end_of_word_suffix") or ""
    if (kind, bool(end)) not in (("bytes", False), ("words", True)) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None

    def last(t: str) -> bool:
        return bool(end) and t.endswith(end)

    vocab, back = model["vocab"], {c: b for b, c in byte_alphabet().items()}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    single = [*back, *(c + end for c in back if end)]
    if any(t not in vocab for t in single) or any(last(a) or last(b) != last(a + b) for a, b in pairs):
        return None
    made = [vocab[a + b] for a, b in pairs]
    if any(a >= b for a, b in zip([max(vocab[t] for t in single), *made], made, strict=False)):
        return None
    marked = byte_alphabet()[MARK[0]]
    tokens = [t for t in (*single, *(a + b for a, b in pairs)) if not end or t == marked or marked not in t]
    inner, final = [t for t in tokens if not last(t)], [t.removesuffix(end) for t in tokens if last(t)]
    free = Tokenizer(models.BPE(vocab=vocab, merges=pairs) if end else whole.model)
    for alone, shown, suffix in ((free, inner, ""), (Tokenizer(whole.model), final, end)):
        if alone.encode(shown, is_pretokenized=True, add_special_tokens=False).ids != [vocab[t + suffix] for t in shown]:
            return None
    return {bytes(back[c] for c in t.removesuffix(end)) + MARK * last(t): vocab[t] for t in tokens}


#: Runs on which a pattern with look-ahead or a merge of one long word could take long.
LONG = re.compile(r"\s{256}|\S{4096}").search


@lru_cache(4)
def text_encoder(path: str) -> Callable[[list[str | None]], list[bytes]]:
    """texts -> little-endian uint32 ids, null being empty: by ranks where that is sure to give the library's ids."""
    whole = library(path)
    with open(path, encoding="utf-8") as f:
        layout = json.load(f)
    table = ranks(layout, whole) if known_layout(layout)[0] == "bytes" else None
    if table is None:
        return encoder(path)
    import tiktoken

    ids_of = tiktoken.Encoding(path, pat_str=BYTE_SPLIT, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(texts: list[str | None]) -> list[bytes]:
        return [b"" if not t else np.array(ids_of(t), dtype="<u4").tobytes() if is_plain(t) and not LONG(t) else by_library(whole, [t])[0] for t in texts]

    return encode


#: Letters of the longest word that is merged by ranks.
LONGEST = 4096


def marked_words(path: str, whole: Tokenizer) -> Callable[[list[str]], list[bytes]] | None:
    """Pre-tokens -> ids by ranks with marked ends, if these are sure to give the library's ids."""
    with open(path, encoding="utf-8") as f:
        table = ranks(json.load(f), whole)
    if table is None or MARK not in table:
        return None
    import tiktoken

    merge = tiktoken.Encoding(path, pat_str=r"[^\n]+\n", mergeable_ranks=table, special_tokens={})
    final = np.zeros(max(table.values()) + 1, dtype=bool)
    final[[i for t, i in table.items() if len(t) > 1 and t.endswith(MARK)]] = True
    mark = MARK.decode()

    def learn(new: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            ids = merge.encode_to_numpy(mark.join(part) + mark, disallowed_special=())
            ends = ((np.flatnonzero(final[ids]) + 1) * 4).tolist()
            data = ids.astype("<u4").tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    return learn


class Words(Chunks):
    """Chunks are the lowered words of plain texts; Arrow numbers them, and each distinct one is looked up once a group.

    others: ids of texts that aren't plain.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], others: Callable[[list[str]], list[bytes]]) -> None:
        super().__init__(encode, KEPT)
        self.others = others

    def _some(self, texts: list[str]) -> list[bytes]:
        other = [i for i, t in enumerate(texts) if t and not is_plain(t)]
        hidden = set(other)
        split = pc.ascii_split_whitespace(pa.array(["" if i in hidden else t.lower() for i, t in enumerate(texts)], pa.large_string()))
        words = pc.dictionary_encode(split.values)
        keys = words.dictionary.to_pylist()
        new = [k for k in self.ids.need(set(keys)) if k]
        self.ids.update(zip(new, self.encode(new), strict=True))
        self.ids[""] = b""  # stands at the ends of a text with white space there
        ids = list(map(self.ids.__getitem__, keys))
        placed = pa.array(ids, pa.large_binary()).take(words.indices)
        _, ends, data = placed.buffers()
        edge = np.frombuffer(ends, np.int64, len(placed) + 1)[split.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else memoryview(b"")
        out = [bytes(data[a:b]) for a, b in zip(edge, edge[1:], strict=False)]
        for i, got in zip(other, self.others([texts[i] for i in other]), strict=True):
            out[i] = got
        return out


@lru_cache(4)
def encoder(path: str) -> Chunks:
    """Ids by the tokenizers library without special tokens; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    whole = library(path)
    model = Tokenizer(whole.model)
    with open(path, encoding="utf-8") as f:
        layout, split = known_layout(json.load(f))
    alphabet, known = byte_alphabet(), Kept(KEPT)
    blank, space = alphabet[32], " " if layout == "bytes" else ""
    by_rank = marked_words(path, whole) if layout == "words" else None

    def learn(new: list[str]) -> list[bytes]:
        if by_rank and not any(len(p) > LONGEST for p in new):
            return by_rank(new)
        out: list[bytes] = []
        for at in range(0, len(new), CALL):
            part = new[at : at + CALL]
            shown = [p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(alphabet) for p in part]
            got = model.encode(shown, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(got.word_ids, dtype=np.int64), np.arange(len(part) + 1)) * 4).tolist()
            out += [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def by_pieces(keys: list[str]) -> list[bytes]:
        pieces = [pieces_of(k, space, split) for k in keys]
        new = list(known.need(set().union(*pieces)))
        known.update(zip(new, learn(new), strict=True))
        get = known.__getitem__
        return [get(ps[0]) if len(ps) == 1 else b"".join([get(p) for p in ps]) for ps in pieces]

    def by_words(keys: list[str]) -> list[bytes]:
        """Words of letters alone are their own pre-token, and not known yet."""
        letters = [k for k in keys if k.isalpha()]
        mixed = [k for k in keys if not k.isalpha()]
        got = dict(zip(letters, learn(letters), strict=True)) | dict(zip(mixed, by_pieces(mixed), strict=True))
        return [got[k] for k in keys]

    if layout == "words":
        return Words(by_words, lambda texts: by_library(whole, texts))

    def encode(keys: list[str]) -> list[bytes]:
        other = [k for k in keys if k[0] == WHOLE]
        if not other:
            return by_pieces(keys)
        plain = [k for k in keys if k[0] != WHOLE]
        got = dict(zip(plain, by_pieces(plain), strict=True)) | dict(zip(other, by_library(whole, [k[1:] for k in other]), strict=True))
        return [got[k] for k in keys]

    def parts(text: str) -> list[str]:
        """Chunks of a plain text at its single spaces, else the text as a whole."""
        if not split or not is_plain(text):
            return [WHOLE + text]
        if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
            return Chunks.cut(text)
        out = text.split(" ")
        out[0] = FIRST + out[0]
        return out

    return Chunks(encode, parts=parts)


@lru_cache(4)
def width(path: str) -> int:
    """Bytes of an id in files: 2 where the vocabulary allows."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
