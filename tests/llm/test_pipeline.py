import random
import re
from collections import Counter

import corpus_pipeline as P

from relspark.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def world():
    """Documents with known fates, and labels."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    text = lambda n=120: [word() for _ in range(n)]
    docs, labels, fate = [], [], {}
    for i in range(900):
        w = text()
        if i % 3 == 1:
            w[rng.randrange(120)] = "vilest" + rng.choice(["", "en", "ung"])
        docs.append((i, " ".join(w), "en", "s", 0, "x"))
        labels.append((i, 1, int(i % 3 == 1)))
        fate[i] = "toxic" if i % 3 == 1 else "kept"
    passage = text(60)
    for i in range(1000, 1010):
        docs.append((i, " ".join(text(70) + passage + text(70)), "en", "s", 0, "x"))
        fate[i] = "cut"
    for i in range(2000, 2010):
        w = text(200)
        docs.append((i, " ".join(w), "en", "s", 0, "x"))
        w[50], w[150] = word(), word()
        docs.append((i + 100, " ".join(w), "en", "s", 0, "x"))
        docs.append((i + 200, docs[-2][1], "en", "s", 0, "x"))
        fate |= {i: "kept", i + 100: "copy", i + 200: "copy"}
    docs += [(3000, None, "en", "s", 0, "x"), (3001, "", "en", "s", 0, "x"), (3002, "too short", None, None, None, "x"), (3003, " ".join(["same"] * 300), "en", "s", 0, "x"), (None, " ".join(text()), "en", "s", 0, "x"), (0, docs[0][1], "en", "s", 0, "x")]
    fate[None] = "kept"
    fate |= {3000: "bad", 3001: "bad", 3002: "bad", 3003: "bad"}
    return docs, labels, fate


def slow_cut(texts, window=35):
    split = {k: WORD.findall(t) for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in split.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in split.items():
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else texts[k]
    return out


def test_stages_against_known_fates(spark, tmp_path):
    docs, labels, fate = world()
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity_score string"
    df = spark.createDataFrame(docs, schema)
    sf = f"file://{tmp_path}"
    df.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    alive, before = df, {d[0]: d[1] for d in docs}
    gone = {"quality rules": {"bad"}, "toxicity": {"toxic"}, "near duplicates": {"copy"}, "substring dedup": set()}
    left = set(fate)
    for n, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, alive, sf)
        assert out.columns == df.columns
        out.write.parquet(f"{sf}/{n}")
        alive = spark.read.parquet(f"{sf}/{n}")
        rows = alive.collect()
        left = {k for k in left if fate[k] not in gone[name]}
        assert {r.doc_id for r in rows} == left, name
        if name == "near duplicates":
            assert len(rows) == len(left)
        if name == "substring dedup":
            want = slow_cut({k: before[k] for k in left})
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == (len(r.text) if fate[r.doc_id] == "cut" else 0) for r in rows)
    rows = P.STAGES[-1][1](spark, alive, sf).collect()
    assert {r.doc_id for r in rows} == left
    whole = P.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows), key=str)


def test_empty_table(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() == 0
    assert toxicity.train([], 0.0) is None
