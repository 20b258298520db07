"""Quality scores by voting of the nearest labelled texts in a latent-semantic space.

A text's vector counts hashed n-grams of its bytes and of its letter shapes, and how much of it repeats; TF-IDF
weights them and a truncated singular value decomposition maps them to ``dimensions`` numbers. ``score``
multiplies every text's vector with all labelled vectors, block by block, and lets the ``neighbours`` with the
largest cosines vote with weights that grow with the cosine.

``fit`` learns from at most ``size`` labelled rows, chosen by a hash of the text, so its model has a bounded
size (some 3 MB by default) and is broadcast; every row is scored, over its whole text. Rows without a label
teach nothing. A null or empty text, and every text under a model without labels, gets the share of label 1.
Equal texts get equal scores. Other columns pass through, one named like the output is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import grams
from turnloom.llm.arrow import drop_column, mapped

WIDTH = 2048
# Shapes: capitals, small letters, digits and spaces are alike, other characters stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[9:14], _SHAPE[128:] = 65, 97, 48, 32, 97
_REPEAT_LEVELS = 16


def features(data: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Counts of byte n-grams, shape n-grams and the level of repetition."""
    raw = grams.counted(data, row, n, (2, 3), WIDTH)
    shapes = grams.counted(_SHAPE[data], row, n, (2, 4), WIDTH // 2)
    total = raw.sum(axis=1)
    # Texts of the same length differ in how many different n-grams they have.
    different = (raw > 0).sum(axis=1) / np.maximum(1, np.minimum(total / 2, WIDTH / 2))
    level = np.clip((different * _REPEAT_LEVELS / 2).astype(int), 0, _REPEAT_LEVELS - 1)
    repeats = np.zeros((n, _REPEAT_LEVELS), np.float32)
    repeats[np.arange(n), level] = np.where(total > 0, 50, 0)
    return np.concatenate((raw, shapes, repeats), axis=1)


@dataclass
class Model:
    idf: np.ndarray
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _latent(x: np.ndarray, model_mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return grams.unit((x - model_mean) @ basis)


def decomposed(x: np.ndarray, dimensions: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors for the largest singular values, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(0).standard_normal((x.shape[1], min(dimensions, *x.shape) + 8)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    small = np.linalg.svd(x @ basis, full_matrices=False)[2]
    return (basis @ small.T)[:, :dimensions].astype(np.float32)


def fit(df: DataFrame, text: str = "text", label: str = "quality", size: int = 4096, dimensions: int = 48) -> Model:
    """The model for 0/1 labels; the sample's decomposition runs in one task."""
    rows = (df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label")).dropna()
            .filter(F.col("text") != ""))
    chosen = grams.sample(rows, None, size, "text").coalesce(1)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, labels = [], []
        for batch in batches:
            labels.append(batch.column(1).to_numpy())
            blocks += [x for _, _, x in grams.vectors(batch.column(0), features)]
        if blocks:
            counts, y = np.concatenate(blocks), np.concatenate(labels).astype(np.float32)
            idf = grams.inverse_frequency(counts)
            x = grams.weighted(counts, idf)
            mean = x.mean(axis=0)
            basis = decomposed(x - mean, dimensions)
            model = Model(idf, mean, basis, _latent(x, mean, basis), y, float(y.mean()))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = chosen.mapInArrow(learnt, "model BINARY").collect()
    none = np.zeros((0, 0), np.float32)
    return pickle.loads(bytes(found[0].model)) if found else Model(none, none, none, none, none, 0.5)


def votes(vectors: np.ndarray, model: Model, neighbours: int, power: float) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors."""
    k = min(neighbours, len(model.labels))
    similarity = vectors @ model.vectors.T
    near = np.argpartition(similarity, len(model.labels) - k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(similarity, near, axis=1), 0) ** power + 1e-9
    return (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True,
          neighbours: int = 21, power: float = 4.0) -> DataFrame:
    """``df`` with the score of ``text``, 0 to 1."""
    df = drop_column(df, out)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = np.full(batch.num_rows, m.prior)
            if len(m.labels):
                for a, b, x in grams.vectors(batch.column(text), features, m.idf):
                    some = x.any(axis=1)
                    if some.any():
                        scores[a:b][some] = votes(_latent(x[some], m.mean, m.basis), m, neighbours, power)
            yield mapped(batch, out, pa.array(np.clip(scores, 0, 1)), without=() if keep_text else (text,))

    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))
