"""Line dedup against plain Python."""

import random

import pytest

from turnloom.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LONG = ["this line is long enough to be compared with others, number %d" % i for i in range(6)]


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def plain(docs, min_docs=5):
    held = {}
    for n, (i, text) in enumerate(docs):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, set()).add((i is not None, i or 0))
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_against_plain(spark):
    rng = random.Random(3)
    docs = []
    for i in range(60):
        lines = [rng.choice([*LONG, LONG[0].upper(), "  " + LONG[1] + "\t", "short", "", f"own line {i} " + "é" * 40])
                 for _ in range(rng.randint(0, 8))]
        docs.append((i, "\n".join(lines)))
    docs += [(None, LONG[0]), (100, None), (101, ""), (102, LONG[2] + "\n" + LONG[2]), (102, LONG[2])]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING").repartition(5)
    got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs)
    small = line_dedup.dedup_lines(df, bits=64).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, small), key=repr) == sorted(map(tuple, got), key=repr)  # a full filter changes nothing


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x", 2)], "doc_id LONG, text STRING, _a STRING, n_lines INT")
    out = line_dedup.dedup_lines(df, out="text")
    assert set(out.columns) == {"doc_id", "text", "_a", "n_lines", "n_dropped"} and out.first().n_lines == 1
    rows = [(i, LONG[0], i + 10, i + 20, i + 30, i + 40, i + 50) for i in range(6)]
    df = spark.createDataFrame(rows, "_id LONG, text STRING, _a INT, _b INT, _k INT, _drop INT, row INT")
    out = line_dedup.dedup_lines(df, doc_id="_id")
    assert out.columns == [*df.columns, "n_lines", "n_dropped", "kept_text"]
    assert line_dedup.dedup_lines(df.limit(0), doc_id="_id").count() == 0
    assert sorted(tuple(r)[:7] for r in out.collect()) == rows and sum(r.n_dropped for r in out.collect()) == 5


def test_rows_with_one_id_are_one_document(spark):
    rows = [(1, LONG[0])] * 4 + [(2, LONG[0])]
    assert {r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()} == {0}


@pytest.mark.parametrize("line", [LONG[0], "  ÄÖÜ " + LONG[1].upper() + "\r", "x" * 39, "\x0b" + "é" * 40])
def test_key_hash_is_sparks(spark, line):
    df = spark.createDataFrame([(line,)], "text STRING")
    hashes = line_dedup._with_keys(df, "text", 40).first()["_a"]
    assert hashes == ([] if line_dedup._key_hash(line, 40) is None else [line_dedup._key_hash(line, 40)])
