"""Near duplicates against all pairs, on planted groups."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import near_dedup as nd

S = nd.Settings(cells=1 << 14)


def _document(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return words


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    texts = [" ".join(_document(rng, rng.randint(3, 150))) for _ in range(60)]
    for size, edits in ((2, 1), (5, 2), (90, 2), (40, 3)):
        base = _document(rng, 120)
        texts += [" ".join(_edited(rng, base, rng.randint(0, edits))) for _ in range(size)]
    passage = _document(rng, 60)  # shared, but less than half of each
    texts += [" ".join(_document(rng, 70) + passage) for _ in range(60)]
    texts += [texts[0]] * 30 + [texts[1].upper() + "!!"] + ["", " .,\n", "a", "a", "one two three", None]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def plain_classes(docs, weights):
    found = [nd.shingles(pa.array([t], pa.string()), S.size) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(found):
        for j in range(i):
            if len(x.hash) and len(found[j].hash) and nd.weighted_jaccard(x, found[j], weights, S.cells) >= S.threshold:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def test_classes_are_those_of_all_pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4)
    got = {r.doc_id: r.class_id for r in nd.classes(df, settings=S).collect()}
    assert got == plain_classes(docs, nd.shingle_weights(df.select("text"), "text", S))
    sizes = {r.class_id: r.class_size for r in nd.classes(df, settings=nd.Settings(cells=1 << 14, estimate=0.0, block=16)).collect()}
    assert sizes == dict(Counter(got.values()))  # the same classes where every candidate is verified, in small blocks
    kept = [r.doc_id for r in nd.keep_first(df, settings=S).collect()]
    assert sorted(kept) == sorted({c for c in got.values()})


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = random.Random(2)
    base = _document(rng, 400)
    column = pa.array([" ".join(base), " ".join(_edited(rng, base, 15))])
    x = nd.shingles(column, 5)
    weight = np.ones(S.cells, np.float32) * 1.3
    drawn = nd.samples(x, weight[nd._cell(x.hash, S.cells)] * x.count, 600)
    similarity = nd.weighted_jaccard(*(nd.shingles(column.slice(i, 1), 5) for i in range(2)), weight, S.cells)
    assert abs((drawn[0] == drawn[1]).mean() - similarity) < 0.06


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "some words that are the same in every one of these rows"
    df = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (5, "quite other words stand here instead of those", 4),
                                (7, "", 5), (7, "", 6)], "doc_id LONG, text STRING, _h INT")
    rows = nd.classes(df, settings=S).collect()
    assert len(rows) == 6 and all(r.class_id in (5, 7) for r in rows)
    kept = sorted((r.doc_id, r.text) for r in nd.keep_first(df, settings=S).collect())
    assert kept == [(5, "quite other words stand here instead of those"), (5, text), (7, "")]
    assert nd.classes(df.limit(0), settings=S).count() == 0 and nd.keep_first(df.limit(0), settings=S).count() == 0


def test_copies_of_copies_in_a_large_group(spark):
    rng = random.Random(11)
    copies = [_document(rng, 120)]
    while len(copies) < 2000:
        base = rng.choice(copies[1:]) if len(copies) > 1 and rng.random() < 0.35 else copies[0]
        copies.append(_edited(rng, base, rng.randint(1, 4)))
    docs = [(i, " ".join(w)) for i, w in enumerate(copies)]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(4)
    weights = nd.shingle_weights(df.select("text"), "text", S)
    x = nd.shingles(pa.array([t for _, t in docs]), S.size)
    drawn = nd.samples(x, weights[nd._cell(x.hash, S.cells)] * x.count, S.bands * S.rows)
    weight = x.count * weights[nd._cell(x.hash, S.cells)].astype(float)
    known, at = np.unique(x.hash, return_inverse=True)
    total = np.bincount(x.row, weight)
    start = np.searchsorted(x.row, np.arange(x.n))
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):  # all pairs that share a band
        row = np.zeros(len(known))
        row[at[x.row == i]] = weight[x.row == i]
        shared = np.add.reduceat(np.minimum(row[at], weight), start)
        same = (drawn == drawn[i]).reshape(len(docs), S.bands, S.rows)
        near = (shared >= S.threshold * (total + total[i] - shared)) & same.all(axis=2).any(axis=1) & (same.mean(axis=(1, 2)) >= S.estimate)
        for j in np.flatnonzero(near[:i]):
            parent[root(i)] = root(j)
    least = {}
    for i in range(len(docs)):
        least.setdefault(root(i), i)
    got = {r.doc_id: r.class_id for r in nd.classes(df, settings=nd.Settings(cells=1 << 14, block=300)).collect()}
    assert 10 < len(least) < 1900
    assert got == {i: least[root(i)] for i in range(len(docs))}


def test_clashing_columns(spark):
    text = "some words that are the same in every one of these rows"
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4), (2, text + "!", 5, 6, 7, 8), (2, text + "!", 9, 6, 7, 8), (3, None, 9, 9, 9, 9)],
                               "_id LONG, text STRING, _dh INT, _rid INT, _rh INT, row INT")
    kept = nd.keep_first(df, doc_id="_id", settings=S)
    assert kept.columns == df.columns
    assert sorted((r._id, r._dh, r._rid, r._rh, r.row) for r in kept.collect()) == [(1, 1, 2, 3, 4), (3, 9, 9, 9, 9)]


def test_words_of_any_script():
    def count(text):
        return len(nd.words(pa.array([text])).hash)

    assert [count(t) for t in ("a b", "a b", "“a” – b…", "北京市", "北京a1市", "กำ", "naïve café", "한국어 말", "x́y", "", "¿qué?", "🙂 a", "ab東c")] == [
        2, 2, 2, 3, 4, 2, 2, 2, 1, 0, 1, 1, 3]
