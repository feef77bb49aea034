import pytest
from pyspark.sql import functions as F

from relspark.functions import text as T
from relspark.operators import policy, prepare


def test_balance_targets_the_focus_class(spark):
    rows = [(c, i) for c, n in ((1, 300), (2, 900), (3, 300), (4, 300)) for i in range(n)]
    out = prepare.balance(spark.createDataFrame(rows, "label int, i int"), "label", 2, F.col("i"))
    sizes = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {1: 150, 2: 900, 3: 150, 4: 150}  # strides of ceil(300 / 299) = 2


def test_quota_sample_is_topped_up(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 40, 2)]) for i in range(100)], "k int, s string")
    out = prepare.quota_sample(df, "s", "k", 33).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in out} == {"a": 14, "b": 13, "c": 6}


def test_evidence_reasons(spark):
    rows = [(1, [(0.9, "CC0"), (0.1, "CC0")]), (2, [(0.1, "CC0")]), (3, [(0.9, " None ")]), (4, []), (5, None), (6, [(0.9, "MIT")])]
    df = spark.createDataFrame(rows, "k int, e array<struct<score:double,license:string>>")
    kept, reason = policy.evidence_filter(F.col("e"), 0.35)
    got = {r.k: (r.n, r.reason) for r in df.select("k", F.coalesce(F.size(kept), F.lit(0)).alias("n"), reason.alias("reason")).collect()}
    assert got == {1: (1, "EVIDENCE_FILTERED"), 2: (0, "EVIDENCE_INSUFFICIENT"), 3: (0, "EVIDENCE_LICENSE_UNRESOLVED"), 4: (0, "EVIDENCE_INSUFFICIENT"), 5: (0, "EVIDENCE_INSUFFICIENT"), 6: (1, None)}


def test_reports_and_reward_audit(spark):
    rows = [("base", 0.1, 0.1, 0.1, 0.1, True), ("sft", 0.5, 0.5, 0.5, 0.1, True), ("grpo", 0.6, 0.4, 0.7, 0.0, True)]
    df = spark.createDataFrame(rows, "model string, mean_reward double, citation_accuracy double, policy_accuracy double, violation_rate double, gate boolean")
    r = policy.compare_reports(df).first()
    assert r.deploy and r.safety_not_worse and round(r.reward_delta, 6) == 0.1 and round(r.citation_delta, 6) == -0.1
    with pytest.raises(ValueError):
        policy.compare_reports(df.limit(2))
    done = spark.createDataFrame([("m", 0.9, 5, False), ("m", 0.2, 9, True), ("n", 0.5, 3, True)], "model string, reward double, words int, ok boolean")
    got = {r.model: (r.unsafe_high, r.passed) for r in policy.reward_audit(done, "reward", "words", "ok", ["model"]).collect()}
    assert got == {"m": (1, False), "n": (0, True)}


def test_groups_pairs_and_bins(spark):
    members = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "b"), (5, "b"), (6, None)], "k long, g string")
    near = spark.createDataFrame([(3, 4)], "a long, b long")
    assert {r.k: r.cluster for r in policy.merged_groups(members, "k", "g", near).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 6}
    with pytest.raises(Exception, match="doesn't pair"):
        policy.paired(members.select("k"), members.limit(3).select("k"), "k").collect()
    with pytest.raises(Exception, match="doesn't pair: 1"):
        policy.paired(members, members.unionByName(members.where("k = 1")).select("k", F.lit(1).alias("x")), "k").collect()
    assert policy.paired(members, members.select("k", F.lit(1).alias("x")), "k").where("x = 1").count() == 6


def test_normal_form_and_claims(spark):
    rows = [("Café &eacute; &copy;&#x41; &amp;lt;", "café é a lt"), ("Straße", "strasse"), (None, ""), ("plain Text", "plain text")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, w string").select(T.normalized(F.col("t"))).collect()]
    assert got == [w for _, w in rows]
    one = spark.createDataFrame([("You definitely have a problem",)], "t string").select(T.has(F.col("t"), T.CLAIM), T.has(F.col("t"), T.DIAGNOSIS)).first()
    assert tuple(one) == (True, False)
    crisis = spark.createDataFrame([("END  my\nlife",), ("self  harm",), ("hurt someone",), (None,)], "t string").select(policy.runtime_crisis(F.col("t"))).collect()
    assert [r[0] for r in crisis] == [True, True, False, False]
