"""Classifiers: held-out accuracy on invented classes, exact votes, and edge cases."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnloom.llm import grams, language_id, quality_classifier

SYLLABLES = {"aa": ["tha", "ing", "ent", "wor", "the"], "bb": ["schu", "ung", "ber", "kei", "zu"], "cc": ["ción", "ado", "que", "ez", "ñar"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _documents(spark, seed, n=300):
    rng = random.Random(seed)
    rows = [(i, lang, _text(rng, lang, rng.randint(4, 60))) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]
    return spark.createDataFrame(rows, "doc_id LONG, lang STRING, text STRING")


def test_held_out_is_crc32_of_the_decimal_id(spark):
    df = spark.createDataFrame([(i,) for i in (*range(40), -3, None)], "doc_id LONG")
    import zlib
    for r in df.withColumn("h", grams.held_out()).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_sample_is_bounded_and_takes_whole_groups_that_are_small(spark):
    df = spark.createDataFrame([(i, "big" if i % 50 else "small", f"t{i}") for i in range(5000)], "i INT, g STRING, k STRING")
    counts = {r.g: r["count"] for r in grams.sample(df, "g", 200, "k").groupBy("g").count().collect()}
    assert counts["small"] == 100 and counts["big"] == 200
    assert grams.sample(df, None, 300, "k").count() == 300


def test_copies_count_once_in_the_sample(spark):
    df = spark.createDataFrame([("x", f"t{i % 20}") for i in range(30000)], "g STRING, k STRING")
    assert sorted(r.k for r in grams.sample(df, "g", 50, "k").collect()) == sorted(f"t{i}" for i in range(20))


def test_gram_counts():
    data, row = np.frombuffer(b"abcab", np.uint8), np.array([0, 0, 0, 1, 1])
    counts = grams.counted(data, row, 2, (2,), 64)
    assert counts.sum(axis=1).tolist() == [2, 1] and (counts.max(axis=0) > 0).sum() == 2


def test_language(spark):
    train = _documents(spark, 1).union(spark.createDataFrame([(1, None, "tha tha"), (2, "aa", None), (3, "aa", "123")], "doc_id LONG, lang STRING, text STRING"))
    model = language_id.fit(train, per_language=80)
    assert model.languages == ["aa", "bb", "cc"] and len(model.centroids) == 9
    test = _documents(spark, 2).withColumn("score", F.lit("clash"))
    out = language_id.identify(test, model).collect()
    assert np.mean([r.lang == r.lang_nearest for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and np.mean([r.rejected for r in out]) < 0.1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "xyzzy qwfp qxkjv"), (5, "the " * 50000)], "doc_id LONG, text STRING")
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [got[i].lang_nearest for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].rejected and got[4].lang_found == "und" and got[4].lang_nearest != "und"
    assert got[5].lang_nearest == "aa"
    none = language_id.fit(train.limit(0))
    assert {r.lang_nearest for r in language_id.identify(test, none).collect()} == {"und"}
    assert language_id.identify(test.limit(0), model).count() == 0


def test_quality(spark):
    def rows(seed, n=400):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            text = _text(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 60))
            bad = rng.random() < 0.3
            out.append((i, " ".join(w + "###" for w in text.split()) if bad else text, int(not bad)))
        return spark.createDataFrame(out, "doc_id LONG, text STRING, quality INT")

    train = rows(1).union(spark.createDataFrame([(1, "x", None), (2, None, 1), (3, "", 0)], "doc_id LONG, text STRING, quality INT"))
    model = quality_classifier.fit(train, size=250, dimensions=16)
    assert len(model.labels) <= 250 and model.basis.shape[1] == 16
    out = quality_classifier.score(rows(2), model).collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in out]) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "word " * 60000), (3, "a")], "doc_id LONG, text STRING")
    got = {r.doc_id: r.score for r in quality_classifier.score(odd, model).collect()}
    assert got[1] == got[2] == model.prior and all(0 <= s <= 1 for s in got.values())
    none = quality_classifier.fit(train.limit(0))
    assert {r.score for r in quality_classifier.score(odd, none).collect()} == {0.5}


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    labelled, x = grams.unit(rng.normal(size=(50, 4))), grams.unit(rng.normal(size=(30, 4)))
    labels = rng.integers(0, 2, 50).astype(np.float32)
    model = quality_classifier.Model(None, None, None, labelled, labels, 0.5)
    got = quality_classifier.votes(x, model, 7, 4.0)
    for vector, score in zip(x, got):
        similarity = labelled @ vector
        near = np.argsort(-similarity)[:7]
        weight = np.maximum(similarity[near], 0) ** 4 + 1e-9
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-9


def test_equal_texts_get_equal_vectors_in_any_batch():
    a = pa.array(["The one", None, "", "Ärger É" * 400])
    b = pa.array(["pad" * 1000, *a.to_pylist()])
    for features in (language_id.features, quality_classifier.features):
        x, y = (np.concatenate([v for *_, v in grams.vectors(c, features)]) for c in (a, b))
        assert np.array_equal(x, y[1:])


def test_samples_of_many_groups_and_hot_ones(spark, monkeypatch):
    rows = [(f"g{i}", f"text {i}") for i in range(1500)] + [("hot", f"hot {i}") for i in range(3000)] + [("hot", "same")] * 500
    rows += [(None, "x"), ("nul", None)]
    df = spark.createDataFrame(rows, "lang STRING, text STRING").repartition(3)
    found = []
    for sent in (grams.SENT, 0):  # thresholds sent to the tasks, or joined by salted keys
        monkeypatch.setattr(grams, "SENT", sent)
        out = grams.sample(df, "lang", 10, "text")
        assert out.columns == ["lang", "text"]
        found.append(sorted(map(tuple, out.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 1500 + 10 + 1
