"""Greedy string tiling against a plain version on words, and planted passages."""

import random

import numpy as np

from turnloom.llm import decontamination as dc


def plain_tiles(document, item, size):
    """Longest common unmarked run first; earliest in the item, then in the document."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(document)):
                n = 0
                while (i + n < len(item) and d + n < len(document) and item[i + n] == document[d + n]
                       and i + n not in used_i and d + n not in used_d):
                    n += 1
                if n >= size and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return total
        n, i, d = best
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))
        total += n


def test_tiles_are_those_of_the_plain_version():
    rng = random.Random(0)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        document = [rng.choice("abcd") for _ in range(rng.randint(1, 25))]
        points = [(d, i) for d in range(len(document) - 1) for i in range(len(item) - 1) if document[d:d + 2] == item[i:i + 2]]
        at_document = [np.array(sorted(d for d, j in points if j == i), np.int64) for i in range(max(len(item) - 1, 0))]
        got = dc.tiles(at_document, 2)
        assert sum(n for *_, n in got) == plain_tiles(document, item, 2)
        for d, i, n in got:
            assert document[d:d + n] == item[i:i + n]


def _words(rng, n):
    return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(3)
    items = [_words(rng, n) for n in (40, 25, 60, 3)]
    benchmark = [(i, " ".join(w)) for i, w in enumerate(items)] + [(None, None), (9, ""), (10, " ".join(items[0]))]
    a = items[0]
    shuffled = a[30:] + _words(rng, 3) + a[15:30] + a[:15]
    edited = [w if k % 9 else "changed" for k, w in enumerate(items[2])]
    docs = [(1, _words(rng, 50)), (2, _words(rng, 20) + a + _words(rng, 20)), (3, shuffled), (4, edited), (5, a[:12] + _words(rng, 9)),
            (6, items[3] * 5), (7, items[1] + items[2]), (8, [w.upper() + "," for w in items[1]])]
    rows = [(i, " ".join(w)) for i, w in docs] + [(2, " ".join(_words(rng, 9))), (8, " ".join(w.upper() for w in items[1])),
                                                  (None, " ".join(items[1])), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    df = df.selectExpr("*", "'x' AS item", "1 AS contaminated")
    bench = spark.createDataFrame(benchmark, "item_id LONG, text STRING")
    out = dc.flag(df, bench).collect()
    assert len(out) == len(rows)
    found = sorted((str(r.doc_id), r.item, round(r.covered, 2), r.n_items) for r in out if r.contaminated)
    assert found == [("2", 0, 1.0, 2), ("3", 0, 1.0, 2), ("4", 2, 0.88, 1), ("6", 3, 1.0, 1), ("7", 1, 1.0, 2), ("8", 1, 1.0, 1), ("8", 1, 1.0, 1),
                     ("None", 1, 1.0, 1)]
    assert {r.doc_id: round(r.covered, 2) for r in out if not r.contaminated}[5] == 0.3
    assert dc.flag(df, bench.limit(0)).filter("contaminated").count() == 0
    assert dc.flag(df.limit(0), bench).count() == 0


def test_short_and_unspaced_items(spark):
    items = ["two words", "word", "北京是中华人民共和国的首都城市", "東京は日本の首都です", "กรุงเทพเป็นเมืองหลวง", "three short words", "…!?"]
    docs = ["these are two words here", "Two, WORDS", "two other words", "a word", "words", "他说“北京是中华人民共和国的首都城市”。", "北京 上海",
            "昔、東京は日本の首都です。", "กรุงเทพเป็นเมืองหลวง", "three short", "three short\u3000words", "…!?", "", None]
    want = [["0"], ["0"], [], ["1"], [], ["2"], [], ["3"], ["4"], [], ["5"], [], [], []]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id LONG, text STRING")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id LONG, text STRING")
    out = sorted(dc.flag(df, bench).collect(), key=lambda r: r.doc_id)
    assert [[str(r.item)] if r.contaminated else [] for r in out] == want


def test_repeated_words_and_long_texts(spark):
    item = "go " * 300
    docs = ["go " * 200_000, "go " * 100 + "stop " + "go " * 100, "go on " * 5000, "word " * 200_000]
    bench = spark.createDataFrame([(0, item), (1, "on go on go")], "item_id LONG, text STRING")
    out = {r.doc_id: r for r in dc.flag(spark.createDataFrame(list(enumerate(docs)), "doc_id LONG, text STRING"), bench).collect()}
    assert [out[i].contaminated for i in range(4)] == [True, True, True, False]
    assert out[0].covered == 1.0 and round(out[1].covered, 3) == 0.667 and out[2].item == 1


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("one two three four five", 1, 2, 3, 4, 5), (None, 2, 3, 4, 5, 6)],
                               "text STRING, _id INT, _h INT, _doc INT, _hash INT, row INT")
    bench = spark.createDataFrame([(7, "one two three four five")], "item_id INT, text STRING")
    out = dc.flag(df, bench, doc_id="_id")
    assert out.columns == ["text", "_id", "_h", "_doc", "_hash", "row", "contaminated", "n_items", "covered", "item"]
    assert sorted((r._id, r._hash, r.row, r.contaminated) for r in out.collect()) == [(1, 4, 5, True), (2, 5, 6, False)]
    assert dc.flag(df.limit(0), bench.limit(0), doc_id="_id").count() == 0
