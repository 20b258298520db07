import datetime as dt
import decimal
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnloom.operators import binning, splitters


def days(df, key):
    return [r[1] for r in sorted(df.select(key, "day").collect())]


def expected_runs(n, k):
    return [((i + 1) * k - 1) // n for i in range(n)]


@pytest.mark.parametrize("n,k", [(1, 7), (3, 7), (7, 7), (20, 3), (1000, 7), (11, 1)])
def test_rows(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "conversation_id")
    assert days(binning.bin_by_rows(df, k), "conversation_id") == expected_runs(n, k)


def test_published_sizes(spark):
    df = spark.range(11001).withColumnRenamed("id", "conversation_id")
    sizes = [r["count"] for r in sorted(binning.bin_by_rows(df, 7).groupBy("day").count().collect())]
    assert sizes == [1571, 1572, 1571, 1572, 1571, 1572, 1572]


def test_rows_with_sparse_keys(spark):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(-10**15, 10**15), 500) + [10**17 + i for i in range(200)])
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))], "conversation_id BIGINT")
    assert days(binning.bin_by_rows(df, 9), "conversation_id") == expected_runs(len(keys), 9)


@pytest.mark.parametrize("kind,make", [
    ("STRING", lambda i: f"{'äz' if i % 3 else 'Ab'}{i * 7919 % 30011}"),
    ("DECIMAL(30,4)", lambda i: decimal.Decimal(i * 7919 % 30011) / 16 - 500),
    ("TIMESTAMP_NTZ", lambda i: dt.datetime(1969, 12, 31, 23) + dt.timedelta(microseconds=i * 7919 % 30011 * 997)),
    ("TIMESTAMP", lambda i: dt.datetime(2024, 10, 27) + dt.timedelta(seconds=i * 7919 % 30011)),
])
def test_rows_by_any_order(spark, kind, make, monkeypatch):
    monkeypatch.setattr(splitters, "SAMPLE", 64)  # several passes
    keys = sorted({make(i) for i in range(900)})
    rng = random.Random(2)
    df = spark.createDataFrame([(k,) for k in rng.sample(keys, len(keys))] + [(None,)], f"conversation_id {kind}")
    binned = {r[0]: r[1] for r in binning.bin_by_rows(df, 9).collect()}
    assert binned.pop(None) is None
    assert [binned[k] for k in keys] == expected_runs(len(keys), 9)


def test_rows_by_two_columns_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(splitters, "SAMPLE", 16)
    rng = random.Random(5)
    rows = [(rng.choice("abc"), i) for i in range(600)] + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "kind STRING, id INT").repartition(3)
    binned = {(r.kind, r.id): r.day for r in binning.bin_by_rows(df, 7, ["kind", "id"]).collect()}
    assert binned.pop((None, 1)) is None and binned.pop(("a", None)) is None
    assert [binned[k] for k in sorted(binned)] == expected_runs(600, 7)
    # Three keys with hundreds of rows each: the runs start with the key that holds their rank.
    order = splitters.Order(df, ["kind"])
    ordered = sorted(k for k, _ in rows if k)
    ranks = [0, 100, 300, 599]
    assert [r.k0 for r in splitters.keys_at(order, ranks, len(ordered))] == [ordered[r] for r in ranks]
    with pytest.raises(ValueError):
        splitters.keys_at(order, [len(ordered)], len(ordered))
    with pytest.raises(TypeError):
        splitters.Order(spark.createDataFrame([], "x MAP<INT,INT>"), ["x"])


def test_sessions_by_string_id_and_by_two_columns(spark):
    rows = [("z", 0, 0), ("a", 0, 1), ("z", 1, 0), ("m", 1, 1), ("a", 1, 2), ("b", 2, 0), (None, 2, 1), ("n", None, 3)]
    df = spark.createDataFrame(rows, "session_id STRING, hour INT, nr INT")
    by_id = {r.session_id: r.day for r in binning.bin_by_session(df, 5).collect()}
    assert by_id == {"a": 0, "b": 1, "m": 2, "n": 3, "z": 4, None: None}
    first_seen = {r.session_id: r.day for r in binning.bin_by_session(df, 4, order_by=["hour", "nr"]).collect()}
    assert (first_seen.pop(None), first_seen.pop("n")) == (None, None)
    places = dict(zip(["z", "a", "m", "b"], range(4)))
    assert {k: d - first_seen["z"] for k, d in first_seen.items()} == places
    empty = binning.bin_by_session(df.limit(0), 4, order_by=["hour", "nr"])
    assert empty.count() == 0


def test_empty_and_invalid(spark):
    empty = spark.range(0).withColumnRenamed("id", "conversation_id")
    assert binning.bin_by_rows(empty).dtypes[-1] == ("day", "int")
    with pytest.raises(ValueError):
        binning.bin_by_rows(empty, 0)
    with pytest.raises(KeyError):
        binning.bin_by_session(empty)
    with pytest.raises(KeyError):
        binning.bin_by_timestamp(empty)
    with pytest.raises(ValueError):
        binning.assign_days(empty, strategy="moon")


def test_sessions_by_first_appearance(spark):
    rows = [(0, "z"), (1, "a"), (2, "z"), (3, "m"), (4, "a"), (5, "b")]
    df = spark.createDataFrame(rows, "row BIGINT, session_id STRING")
    binned = binning.bin_by_session(df, 2, "session_id", "row")
    assert days(binned, "row") == [0, 0, 0, 1, 0, 1]


def test_timestamp_like_equal_width_cut(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    for k in (1, 2, 7, 10):
        times = [start + dt.timedelta(seconds=rng.randint(0, 10**6)) for _ in range(200)]
        df = spark.createDataFrame(list(enumerate(times)), "i INT, ts TIMESTAMP")
        seconds = pd.Series([(t - min(times)).total_seconds() / 86400 for t in times])
        assert days(binning.bin_by_timestamp(df, k), "i") == list(pd.cut(seconds, k, labels=False, include_lowest=True))


def test_timestamp_edges(spark):
    text = spark.createDataFrame([(0, "2024-01-01"), (1, "junk"), (2, None), (3, "2024-01-08")], "i INT, date STRING")
    assert days(binning.bin_by_timestamp(text, 7), "i") == [0, None, None, 6]
    same = spark.createDataFrame([(0, "2024-01-01"), (1, "2024-01-01")], "i INT, date STRING")
    assert days(binning.bin_by_timestamp(same, 7), "i") == [3, 3]
    with pytest.raises(ValueError):
        binning.bin_by_timestamp(text.withColumn("date", F.lit("x")), 7)


def test_strategy(spark):
    ids = spark.range(4).select(F.col("id").alias("conversation_id"), F.lit("x").alias("raw"))
    assert binning.pick_strategy(ids)[0] == "row"
    assert binning.pick_strategy(ids.union(ids)) == ("session", "found grouping column 'conversation_id'")
    assert binning.pick_strategy(ids.withColumn("TS", F.current_timestamp()))[0] == "timestamp"
    binned, info = binning.assign_days(ids, 2)
    assert (info.strategy, info.chronology, info.n_bins) == ("row", "synthetic_row_order", 2)
    assert days(binned, "conversation_id") == [0, 0, 1, 1]
    assert binning.assign_days(ids, 2, "row")[1].reason == "forced by caller"


def test_keys_at_ranks_needs_no_uniform_keys(spark):
    keys = sorted({int(x) for x in np.random.default_rng(0).pareto(0.3, 3000) * 1000})
    df = spark.createDataFrame([(k,) for k in keys], "k BIGINT")
    ranks = [0, 1, len(keys) // 2, len(keys) - 1]
    assert binning.keys_at_ranks(df, "k", ranks, len(keys), keys[0], keys[-1]) == [keys[r] for r in ranks]


def test_null_keys_have_no_day_and_no_rank(spark):
    rows = [(i, None if i % 5 == 0 else i // 3) for i in range(40)]
    df = spark.createDataFrame(rows, "row LONG, session_id LONG")
    for order_by in (None, "row"):
        out = binning.bin_by_session(df, 4, order_by=order_by).collect()
        assert len(out) == 40 and all((r.day is None) == (r.session_id is None) for r in out)
        assert {r.day for r in out} == {0, 1, 2, 3, None}
    keyed = df.select(F.when(F.col("row") % 4 != 0, F.col("row")).alias("k"))
    assert {tuple(r) for r in binning.bin_by_rows(keyed, 3, "k").groupBy("day").count().collect()} == {
        (None, 10), (0, 10), (1, 10), (2, 10)}
    none = spark.createDataFrame([(None,)], "k LONG")
    assert binning.bin_by_rows(none, 3, "k").first().day is None


def test_a_rank_beyond_the_keys_raises(spark):
    df = spark.createDataFrame([(i,) for i in (1, 5, None, 9000)], "k LONG")
    with pytest.raises(ValueError, match="no key at rank"):
        binning.keys_at_ranks(df, "k", [3], 4, 1, 9000)
