"""The assistant's branches, automata over long runs, JSON texts and candidates."""

import json
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relspark.functions import canonical
from relspark.operators import assistant, automaton


def test_automaton_over_levels_of_blocks(spark):
    rng = random.Random(4)
    table = [[1, 0, 2], [2, 2, 0], [0, 1, 2]]
    rows = [(k, i, rng.choice([0, 1, 2, None])) for k in ("a", "b", None) for i in range(0, 300, 1 if k == "a" else 7)] + [("c", None, 1), ("c", -1, 1), ("d", 5, 1)]
    df = spark.createDataFrame(rows, "k string, i long, c int").withColumn("extra", F.lit("x"))
    want, now = {}, {}
    for k, i, c in rows:
        if i is not None and i >= 0:
            want[k, i] = now.get(k, 0)
            now[k] = want[k, i] if c is None else table[want[k, i]][c]
    for size in (4, 64):
        got = automaton.states_before(df, "k", "i", "c", table, size=size)
        assert got.columns == ["k", "i", "c", "extra", "before"]
        found = {(r.k, r.i): r.before for r in got.collect()}
        assert len(found) == len(rows) and {key: found[key] for key in want} == want and found["c", None] is None and found["c", -1] is None
    assert automaton.states_before(df.where("false"), "k", "i", "c", table).count() == 0


def test_branches_of_a_session(spark):
    turns = ["", "I can't finish my thesis", "what?", "Nah!", "ok", "shorter please", " YES. ", "yes", "too much work again", "never mind", "hello there", "I feel suicidal", "work is a lot", "yes"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(turns)] + [(2, 0, None)], "c int, t int, said string")
    got = [r.branch for r in assistant.branches(df, "c", "t", F.col("said"), F.lit(True), size=8).where("c = 1").orderBy("t").collect()]
    assert got == ["explore", "concern>propose>present", "ask_again", "confirm", "none", "refine>propose>present", "confirm>execute>explore", "explore", "concern>propose>present", "confirm", "none", "crisis", "concern", "none"]
    calm = [r.branch for r in assistant.branches(df, "c", "t", F.col("said"), F.lit(False)).where("c = 1").orderBy("t").collect()]
    assert calm == ["none", "reply", "none", "none", "none", "reply", "none", "none", "reply", "none", "reply", "crisis", "reply", "none"]


def test_doubles_are_written_as_python_does(spark):
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 0.001, 2.0**-44, 1e22, 1e23, 5e-324, 1.7976931348623157e308, -2.5, 1 / 3, 100.0, 1234567.0, 12345678.9, float("nan"), float("inf"), -float("inf")]
    xs += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(400)) if x == x] + [round(rng.uniform(-1e6, 1e6), rng.randrange(6)) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [(r.x, r.t) for r in df.select("x", canonical.json_double(F.col("x")).alias("t")).collect()]
    wrong = [(t, json.dumps(x)) for x, t in got if t != json.dumps(x)]
    assert len(wrong) == 0, wrong[:5]


def test_json_texts_equal_pythons(spark):
    rows = [
        ({"b": 1, "a": None, "é": 2}, 'q"\\\n\t\x01/é \x7f', [1.5, None, 1e-7], (True, None, [{"z": "1", "A": "x"}]), 3),
        (None, None, None, None, None),
        ({}, "", [], (False, "x", []), -1),
    ]
    schema = "m map<string,int>, s string, d array<double>, st struct<flag:boolean,name:string,list:array<map<string,string>>>, n long"
    df = spark.createDataFrame(rows, schema)
    whole = F.struct(*df.columns)
    got = [r[0] for r in df.select(canonical.json_text(whole, StructType(df.schema.fields))).collect()]
    tight = [r[0] for r in df.select(canonical.json_text(whole, StructType(df.schema.fields), ",", ":")).collect()]
    for text, close, (m, s, d, st, n) in zip(got, tight, rows, strict=True):
        value = {"m": m, "s": s, "d": d, "st": st and dict(zip(("flag", "name", "list"), st, strict=True)), "n": n}
        assert text == json.dumps(value, ensure_ascii=False, sort_keys=True) and close == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_candidates_are_read_strictly(spark):
    ok = {"response": "a", "policy_target": "ask"}
    cases = [
        (None, "NOT_JSON"), ("", "NOT_JSON"), ("{", "NOT_JSON"), ('{"response": "a", "response": "b", "policy_target": "ask"}', "NOT_JSON"), ("[1]", "NOT_OBJECT"), ("null", "NOT_OBJECT"), ("{}", "MISSING_FIELD"),
        (ok | {"x": 1}, "UNKNOWN_FIELD"), (ok | {"response": None}, "WRONG_TYPE"), (ok | {"response": "\n "}, "RESPONSE_EMPTY"), (ok | {"policy_target": "ASK"}, "TARGET_UNKNOWN"), (ok | {"evidence_ids": None}, "WRONG_TYPE"),
        (ok | {"evidence_ids": ["a", 1]}, "WRONG_TYPE"), (ok | {"uncertainty_acknowledged": 1}, "WRONG_TYPE"), (ok | {"proposed_action": "t"}, "WRONG_TYPE"), (ok | {"proposed_action": {"execution_mode": "dry_run"}}, "ACTION_INVALID"),
        (ok | {"proposed_action": {"tool_name": "t", "requires_confirmation": False}}, "ACTION_INVALID"), (ok, None), (ok | {"proposed_action": {}}, None), (ok | {"evidence_ids": ["é"], "proposed_action": {"tool_name": "t"}, "uncertainty_acknowledged": True}, None),
    ]
    df = spark.createDataFrame([(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string")
    parsed, code = canonical.candidate(F.col("j"))
    got = {r.i: r for r in df.select("i", parsed.alias("p"), code.alias("code")).collect()}
    assert [got[i].code for i in range(len(cases))] == [c for _, c in cases]
    assert tuple(got[len(cases) - 1].p) == ("a", "ASK", ["é"], "t", True) and got[len(cases) - 2].p.tool_name is None
