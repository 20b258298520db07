import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.operators import dense
from turnloom.plans import retrieval as plan
from turnloom.sources import tables


def _texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(40)]
    return [" ".join(rng.choices(words[:8 + 8 * (i % 5)], k=rng.randint(1, 30))) for i in range(150)]


def _matrix(spark, texts, features):
    """Unit TF-IDF rows in plain numpy from the same hashed cells."""
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    rows = df.select("id", dense._cells(F.col("text"), features).alias("cells")).collect()
    counts = np.zeros((len(texts), features))
    for row in rows:
        for cell in row.cells:
            counts[row.id, cell] += 1
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1
    weighted = counts * idf
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    return df, np.divide(weighted, norms, out=np.zeros_like(weighted), where=norms > 0)


def test_singular_values_and_reconstruction(spark):
    df, matrix = _matrix(spark, _texts() + ["", None], 300)
    encoder = dense.fit(df.repartition(40), dimensions=12, features=300, rounds=8, oversample=44)  # two levels of sums
    left, values, right = np.linalg.svd(matrix, full_matrices=False)
    np.testing.assert_allclose(encoder.singular_values, values[:12], rtol=1e-6)
    np.testing.assert_allclose(encoder.basis.T @ encoder.basis, np.eye(12), atol=1e-10)
    projected = np.array([r.embedding for r in encoder.projected(df).orderBy("id").collect()])
    best = (left[:, :12] * values[:12]) @ right[:12]
    np.testing.assert_allclose(projected @ encoder.basis.T, best, atol=1e-4)
    units = np.array([r.embedding for r in encoder(df).orderBy("id").collect()])
    np.testing.assert_allclose(np.linalg.norm(units[:-2], axis=1), 1, atol=1e-6)
    assert not units[-2:].any()


def test_few_rounds_come_close(spark):
    df, matrix = _matrix(spark, _texts(), 300)
    encoder = dense.fit(df, dimensions=12, features=300)
    values = np.linalg.svd(matrix, compute_uv=False)[:12]
    np.testing.assert_allclose(encoder.singular_values, values, rtol=0.05)


def test_empty_table_and_invalid(spark):
    empty = spark.createDataFrame([], "id INT, text STRING")
    encoder = dense.fit(empty, dimensions=4, features=32)
    assert not encoder.singular_values.any() and encoder(empty).count() == 0
    with pytest.raises(ValueError):
        dense.fit(empty, dimensions=40, features=32)


def test_resolve_with_the_dense_encoder(spark):
    other = spark.createDataFrame([(f"c{i}_t0", f"User 1: the weather report number {i} says rain", i, 0, i % 7, 0.0, False)
                                   for i in range(20)], tables.CHUNK_SCHEMA)
    chunks = plan.build_chunks(other, tables.seed_chunks(spark))
    index, encoder = plan.index_chunks(chunks, encoder=dense.fit(chunks, dimensions=16, features=512))
    out = plan.resolve(tables.demo_queries(spark), index, encoder, k=5).collect()
    assert len(out) == 3 and all(any(c.synthetic for c in r.source_chunks) for r in out)


@pytest.mark.parametrize("per_row", [100, 1])
def test_products_hold_little(per_row):
    rng = np.random.default_rng(3)
    rows = np.sort(rng.integers(0, 20_000 // per_row, 20_000))
    columns, values, right = rng.integers(0, 300, 20_000), rng.random(20_000), rng.random((300, 400))
    total = np.zeros((20_000 // per_row, 400))
    tracemalloc.start()
    dense._add_product(total, rows, columns, values, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    matrix = np.zeros((len(total), 300))
    np.add.at(matrix, (rows, columns), values)
    assert np.allclose(total, matrix @ right)
    assert peak < 8_000_000  # a copy of the gathered rows of a whole block takes 26 MB
