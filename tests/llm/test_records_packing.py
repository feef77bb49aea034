import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from relspark.llm import hf, packing, records

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
DOCS = [(1, None, "q"), (2, "", "q"), (3, "Hello  wörld's\n", "q"), (3, "Hello  wörld's\n", "q"), (-4, "ab " * 30000, "q"), (9, "A  É <|endoftext|> x \n y 12ab", "q"), (10, "à ́b ΑΣ Σ", "q")]


@pytest.fixture(params=[WORD, BYTE])
def lib(request):
    t = Tokenizer.from_file(request.param)
    t.encode_special_tokens = True
    return request.param, t


def test_chunks_match_the_library(lib, spark, sf):
    path, t = lib
    texts = [d[1] or "" for d in DOCS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    bits = ["the", "THE", " ", " ", "  ", "\n", "\t", "é", "É", "ß", "İ", "Σ", "日", "😀", "'s", "'S", "1", "23", "!!", "\x00", "\x1f", "\u0301", "\u00a0", "in"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    for x, ids in zip(texts, hf.encoder(path)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, ids string")
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    files = records.write(df, WORD, f"file://{tmp_path}/r", end_id=2)
    got = [(r.key, r.start, r.ids) for r in records.read(spark, files).orderBy("start").collect()]
    start = 0
    for (k, x, _), (key, at, ids) in zip(sorted(DOCS, key=lambda d: d[0]), got, strict=True):
        want = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (key, at, np.frombuffer(ids, "<u4").tolist()) == (k, start, want)
        start += len(want)
    opened = [records.RecordFile(f) for f, _, _ in files]
    seeks = [f[i] for f in opened for i in reversed(range(len(f)))]
    assert sorted(k for k, _ in seeks) == sorted(d[0] for d in DOCS)
    nulls = records.write(df.limit(0).unionByName(spark.createDataFrame([(None, "b", ""), (-5, "a", ""), (None, None, "")], df.schema)), WORD, f"file://{tmp_path}/n", end_id=2)
    assert [r.key for r in records.read(spark, nulls).orderBy("start").collect()] == [None, None, -5]
    bad = tmp_path / "r" / next(f.rsplit("/", 1)[1] for f, n, _ in files if n)
    data = bytearray(bad.read_bytes())
    data[records.HEADER + 14] ^= 1
    bad.write_bytes(data)
    with pytest.raises(ValueError):
        records.RecordFile(f"file://{bad}")[0]
    empty = records.write(df.where("false"), WORD, f"file://{tmp_path}/e", end_id=2)
    assert records.read(spark, empty).count() == 0


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(grid, 3))
    assert sorted(packing.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_packing_holds_each_id_once(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, ids string").where("doc_id <> 3").unionByName(spark.createDataFrame([(7, "x y", "")], "doc_id long, text string, ids string"))
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    rows = packing.pack(df, BYTE, 1024, 0).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) // 4 > 0 and zlib.crc32(r.ids) >= 0
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        own = sorted(docs[r.doc_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist() and own[0].doc_tokens == len(ids)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0] + [p.length for p in s])[:-1].tolist()
        total = sum(p.length for p in s)
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(df.where("false"), BYTE, 1024, 0).count() == 0


def test_ranks_give_the_librarys_ids():
    rng = random.Random(3)
    letters = "aB é \n\t'sré1２ ,.!?ß日本  \x85\x1c😀  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "a" * 5000 + " b", "a" * 4000, " " * 300 + "x", " " * 255 + "x", "\n" * 200, "<|endoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = P.path(name)
        assert hf.text_encoder(path)([None, *texts]) == [b"", *hf.by_library(hf.library(path), texts)]
    assert not isinstance(hf.text_encoder(BYTE), hf.Chunks)


def test_words_at_edges_have_the_librarys_ids():
    texts = ["", " ", "\n", " A b ", "It's  THE\n\nend.", "x\ty", "İstanbul ÀÉ", "日本 語", "don't we'll I'VE 123abc", None, "ét", "\x00\x01 q", "<|endoftext|> hi", "word word"]
    assert hf.encoder(WORD)(texts) == hf.by_library(hf.library(WORD), [t or "" for t in texts])
    assert hf.encoder(WORD)([None, ""]) == [b"", b""]


def test_words_by_ranks_with_marked_ends():
    whole, rng = hf.library(WORD), random.Random(5)
    learn = hf.marked_words(WORD, whole)
    words = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    words += ["".join(rng.choice("aeéüßñøžɏ日w/<>") for _ in range(rng.randrange(1, 9))) for _ in range(2000)] + ["a" * 5000, "</w>", "1", "!!"]
    alone = Tokenizer(whole.model)
    alphabet = hf.byte_alphabet()
    for w, ids in zip(words, learn(words), strict=True):
        shown = "".join(alphabet[b] for b in w.encode())
        assert np.frombuffer(ids, "<u4").tolist() == alone.encode([shown], is_pretokenized=True, add_special_tokens=False).ids
    layout = {"model": {"type": "BPE"}, "pre_tokenizer": None, "normalizer": None}
    assert hf.ranks(layout, whole) is None
