"""Approximate search: recall against the exact search, hot cells, ties, nulls and empty tables."""

import numpy as np

from turnloom.operators import cells, vectors


def _table(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} BIGINT, embedding ARRAY<DOUBLE>").repartition(3)


def test_recall_and_exactness(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 2
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])  # a hot cell of copies
    monkeypatch.setattr(cells, "PART_ROWS", 100)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 10)
    table = _table(spark, x).unionByName(spark.createDataFrame([(5000, None)], "id BIGINT, embedding ARRAY<DOUBLE>"))
    queries = _table(spark, x[::50], "qid").unionByName(spark.createDataFrame([(900, None)], "qid BIGINT, embedding ARRAY<DOUBLE>"))
    index = cells.build(table)
    assert index.rows.count() == 1200 and max(index.parts.values()) > 2
    wanted = vectors.top_k(queries, table, 10)
    ask = cells.cells_to_ask(index, table, 10)
    found = cells.search(queries, index, 10, ask)
    assert 0 < ask < len(index.centroids) and cells.recall(found, wanted) >= 0.9
    every = cells.search(queries, index, 10, len(index.centroids))  # all cells asked: the exact result, ties included
    assert sorted((r.qid, r.cosine_rank, r.id) for r in every.collect()) == sorted((r.qid, r.cosine_rank, r.id) for r in wanted.collect())


def test_empty(spark):
    empty = spark.createDataFrame([], "id BIGINT, embedding ARRAY<FLOAT>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid BIGINT, embedding ARRAY<FLOAT>")
    index = cells.build(empty)
    assert cells.cells_to_ask(index, empty) == 0 and cells.search(queries, index).count() == 0
    assert cells.search(queries.limit(0), cells.build(_table(spark, np.eye(2))), 3, 1).count() == 0
