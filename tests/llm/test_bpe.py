import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from relspark.llm import bpe
from relspark.llm.chunks import Chunks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(4)
    alphabet = ["the", "th", "er", " ", "  ", "\n", " \n", "\t", "é", "ß", "日本", "😀", "'s", "'S", "1", "23", "!!", " ", "\x1f", "a", "in", "g", "<|endoftext|>", "　", "\x00"]
    out = ["", " ", "  ", "a", " a ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "it's  ok \n\n yes", "é" * 500, "x" + " " * 300 + "y"]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(1500)]


def test_ids_match_the_library(enc):
    chunks, _, decoder = bpe.codec(PATH, P.PATTERN)
    for t, ids in zip(texts(), chunks(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
        for step in (1, 3, 1 << 16):
            assert b"".join(bpe.decode_bytes(ids, decoder, step)) == t.encode()
            assert decoder.valid


def test_few_states_and_few_chunks_give_the_same_ids(enc):
    machine = bpe.Transducer(bpe.read_ranks(PATH), most=50)
    own = Chunks(lambda ks: [np.array(enc.encode_ordinary(Chunks.chunk(k)), "<u4").tobytes() for k in ks], kept=5)
    for t in texts()[:300]:
        assert machine.encode(t.encode()) == enc._core_bpe.encode_single_piece(t.encode()) if t else True
        assert np.frombuffer(own([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
        assert "".join(map(Chunks.chunk, Chunks.cut(t))) == t


def test_pairs_stand_as_merging_says():
    machine, rng = bpe.Transducer(bpe.read_ranks(PATH)), random.Random(12)
    short = [t for t, b in machine.bytes_of.items() if len(b) < 5]
    for _ in range(20000):
        a, b = (rng.choice(short) if rng.random() < 0.7 else rng.randrange(50256) for _ in "ab")
        data = machine.bytes_of[a], machine.bytes_of[b]
        assert machine._stands(a, b) == (machine.merge(data[0] + data[1]) == list(data) and len(machine.merge(data[0])) == len(machine.merge(data[1])) == 1)


def test_decoder_holds_back_unfinished_characters():
    ids = {b: bytes([b]) for b in range(256)}
    d = bpe.Decoder(ids)
    out = [d.feed(np.array([b])) for b in "aé😀z".encode()]
    assert b"".join(out) == "aé😀z".encode() and out[1] == b"" and out[2] == "é".encode() and d.valid
    d.clear()
    assert d.feed(np.array([0xFF, 0x41])) + d.close() == b"\xffA" and not d.valid
    d.clear()
    assert d.feed(np.array([0x41, 0xE2, 0x82])) == b"A" and d.close() == b"\xe2\x82" and not d.valid


def test_round_trip_query(spark, sf, enc):
    docs = [(1, None, "q"), (2, "", "q"), (3, "Hello  wörld's\n", "q"), (3, "Hello  wörld's\n", "q"), (4, "ab " * 30000, "q")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.round_trip(df, PATH, P.PATTERN).collect())
    want = []
    for k, t, _ in docs:
        ids = enc.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(df.where("false"), PATH, P.PATTERN).count() == 0
