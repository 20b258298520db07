"""A few registered queries against their DuckDB twins at the smallest scale; tools/check.py runs all."""

import os

import pytest

import __spark_entry__ as registered
from tools import check

SF = "/root/testdata/sf0.001"
FAST = ["turns_strict", "bin_session", "bin_rows_composite", "bin_session_string", "bin_session_first_seen",
        "bin_timestamp", "daily_rollup", "entities_top", "weak_labels", "class_metrics",
        "entities_merged", "turn_pair_chunks", "composite_rerank", "seed_pairs", "pair_features", "contradiction_pairs", "drift_timeline"]


def test_names():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_twin(spark, name):
    df = registered.queries()[name](spark, SF)
    cursor = check.connect(SF).execute(registered.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert check.rows(df.columns, [tuple(r) for r in df.collect()]) == check.rows(columns, cursor.fetchall())
