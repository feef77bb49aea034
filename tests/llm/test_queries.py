"""The opN_ queries with SQL give the SQL's rows on the smallest tables."""

import sys
from pathlib import Path

import pytest

from relspark.llm import queries

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracle  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    assert oracle.compare(spark, oracle.connect(sf), sf, queries.queries()[name], queries.oracle_sql()[name]) is None


def test_names_and_columns(spark, sf):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    got = found["op2_simhash_near_dedup"](spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and all(len(r.fingerprint) == 16 for r in got.collect())
    assert found["op8_toxicity"](spark, sf).columns == ["doc_id", "held_out", "score", "predicted"]
