"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed letter n-grams; spherical k-means makes ``clusters`` centroids of each
language's sample. A text gets the language of the centroid with the largest cosine. It is rejected if that
cosine lies further below the cluster's own members than ``slack`` allows.

``fit`` learns from at most ``per_language`` rows of each language, chosen by a hash of the text; everything
else looks at every row. Rows without text or language teach nothing. A text that is null or has no letter is
``und`` with score 0. Equal texts get equal results; ties between centroids go to the first language in
alphabetical order. An empty table to fit on gives a model that calls everything ``und``. Other columns pass
through, ones named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import grams
from turnloom.llm.arrow import drop_column, mapped
from turnloom.llm.storage import stored

WIDTH = 4096
SIZES = (1, 2, 3)
# Letters in lower case, one space for everything between words.
_CODE = np.full(256, 32, np.uint8)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def features(data: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Counts of n-grams of bytes of letters."""
    code = _CODE[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    code[capital] += 32
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])
    return grams.counted(code[keep], row[keep], n, SIZES, WIDTH)


@dataclass
class Model:
    languages: list[str]
    language: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def clustered(x: np.ndarray, clusters: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors and, for each, the cosine that all but a hundredth of its members reach."""
    centroids = [grams.unit(x.mean(axis=0, keepdims=True))[0]]
    while len(centroids) < min(clusters, len(x)):  # the vector furthest from those chosen comes next
        centroids.append(x[np.argmin((x @ np.stack(centroids).T).max(axis=1))])
    centroids = np.stack(centroids)
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        full = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = grams.unit(np.where(full[:, None], sums, centroids))
    similarity = x @ centroids.T
    nearest, best = similarity.argmax(axis=1), similarity.max(axis=1)
    least = [float(np.quantile(best[nearest == i], 0.01)) if (nearest == i).any() else 1.0 for i in range(len(centroids))]
    return centroids, np.array(least)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 500, clusters: int = 3) -> Model:
    """Centroids of each language in ``df``; a language's sample is clustered in one task."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).dropna()
    chosen = stored(grams.sample(rows.filter(F.col("text").rlike(r"\p{L}")), "lang", per_language, "text"), "langid-sample")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for a, b, counts in grams.vectors(batch.column(0), features):
                total, n = total + (counts > 0).sum(axis=0), n + b - a
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())],
                                         names=["at", "n"])

    frequency = np.zeros(WIDTH)
    n = 0
    for row in chosen.select("text").mapInArrow(found, "at INT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if row.at < 0:
            n = row.n
        else:
            frequency[row.at] = row.n
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        column = pa.array(pdf["text"], pa.string())
        x = np.concatenate([v for _, _, v in grams.vectors(column, features, idf)])
        c, least = clustered(x, clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(c.astype(np.float32)), "least": least})

    rows = chosen.groupBy("lang").applyInPandas(centroids, "lang STRING, centroid ARRAY<FLOAT>, least DOUBLE").collect()
    rows.sort(key=lambda r: (r.lang, r.least))
    languages = sorted({r.lang for r in rows})
    return Model(languages, np.array([languages.index(r.lang) for r in rows], np.int64),
                 np.array([r.centroid for r in rows], np.float32).reshape(-1, WIDTH), np.array([r.least for r in rows]), idf)


def identify(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True, slack: float = 0.15,
             sharpness: float = 20.0) -> DataFrame:
    """``df`` with ``lang_nearest``, ``score`` (0 to 1), ``similarity``, ``rejected`` and ``lang_found``.

    ``score`` weighs the best language against the others, ``sharpness`` times their cosines as exponents.
    ``lang_found`` is ``lang_nearest``, or ``und`` if rejected.
    """
    names = ["lang_nearest", "score", "similarity", "rejected", "lang_found"]
    for name in [*names, "_letters"]:
        df = drop_column(df, name)
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few centroids per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            nearest, score, best, rejected = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            if len(m.languages):
                starts = np.flatnonzero(np.concatenate(([True], m.language[1:] != m.language[:-1])))
                for a, b, x in grams.vectors(batch.column(text), features, m.idf):
                    similarity = x @ m.centroids.T
                    top = similarity.argmax(axis=1)
                    by_language = np.maximum.reduceat(similarity, starts, axis=1)
                    best[a:b] = similarity[np.arange(b - a), top]
                    weight = np.exp(sharpness * (by_language - by_language.max(axis=1, keepdims=True)))
                    score[a:b] = 1 / weight.sum(axis=1)
                    rejected[a:b] = best[a:b] < m.least[top] - slack
                    for i in range(a, b):
                        if letters[i]:
                            nearest[i] = m.languages[m.language[top[i - a]]]
            score[~letters], best[~letters], rejected[~letters] = 0, 0, True
            named = ["und" if r else x for x, r in zip(nearest, rejected)]
            batch = mapped(batch, "lang_nearest", pa.array(nearest, pa.string()),
                           without=("_letters",) if keep_text else ("_letters", text))
            for name, values in zip(names[1:], (pa.array(score), pa.array(best), pa.array(rejected), pa.array(named, pa.string()))):
                batch = mapped(batch, name, values)
            yield batch

    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType(), T.StringType()]
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    fields += [T.StructField(name, kind) for name, kind in zip(names, kinds)]
    has_letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return df.withColumn("_letters", has_letters).mapInArrow(run, T.StructType(fields))
