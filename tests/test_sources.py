import pytest
from pyspark.sql import functions as F

from relspark.operators import metrics, prepare
from relspark.sources import readers, writers


def test_uri():
    assert [writers.uri(x) for x in ("/a/b", "file:/a/b", "hdfs://h/a")] == ["file:///a/b", "file:/a/b", "hdfs://h/a"]


def test_required_columns(spark):
    df = spark.range(1)
    assert readers.require(df, ["id"], "x") is df
    with pytest.raises(ValueError, match="x lacks a, b"):
        readers.require(df, ["a", "id", "b"], "x")


def test_predictions_with_one_of_two(spark):
    df = spark.createDataFrame([("0.5", None), (None, "-1"), ("0.5", "1"), ("", ""), ("x", "2")], "raw_probability string, raw_logit string")
    assert [tuple(r) for r in readers.prediction(df).select("probability", "logit").collect()] == [(0.5, None), (None, -1.0), (None, None), (None, None), (None, 2.0)]
    assert [tuple(r) for r in readers.prediction(df.drop("raw_logit")).select("probability", "logit").limit(1).collect()] == [(0.5, None)]


def test_lines_that_are_no_objects_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n[1]\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.records(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    with pytest.raises(ValueError, match="schema"):
        readers.records(spark, str(tmp_path / "x.jsonl"))


def test_fold_confusion_counts_absent_cells_as_zero(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 1), (1, 1, 1), (1, 1, 1), (1, 1, 0), (1, None, 0)], "fold int, p int, y int")
    got = {(r.predicted, r.label): (r["mean"], r["std"]) for r in metrics.fold_confusion(df, "fold", "p", "y", [0, 1], [0, 1]).collect()}
    assert got == {(0, 0): (0.0, 0.0), (0, 1): (25.0, 25.0), (1, 0): (12.5, 12.5), (1, 1): (50.0, 0.0)}
    assert metrics.fold_confusion(df.limit(0), "fold", "p", "y", [0], [0]).count() == 0


def test_features_over_a_baseline(spark):
    rows = spark.createDataFrame([("a", [2.0, 3.0]), ("b", [1.0, 1.0]), (None, [1.0, None])], "s string, x array<double>")
    base = spark.createDataFrame([("a", [4.0, 0.0])], "s string, b array<double>")
    got = {r.s: r.x for r in prepare.over_baseline(rows, base, ["s"], "x", "b").collect()}
    assert got == {"a": [0.5, None], "b": [None, None], None: [None, None]}


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "x\ny"), ("b.txt", " \n"), ("c.csv", "z")], "name string, page string")
    writers.pages(df, writers.uri(str(tmp_path)))
    assert [r.content for r in readers.text_folder(spark, str(tmp_path)).collect()] == ["x\ny"]
    assert readers.text_folder(spark, str(tmp_path)).where(F.length("id") != 64).count() == 0


def test_csv_gives_texts_back(spark, tmp_path):
    texts = ['say "x", y', " a \n\nb\t", "back\\slash\\", '"', "\\\"", "", None, "a\rb", "c\r\nd", '","', "# x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    writers.csv(df, str(tmp_path / "x"))
    got = {int(r.i): r.t for r in readers.records(spark, str(tmp_path / "x")).collect()}
    assert got == {i: t or None for i, t in enumerate(texts)}
