"""The pipeline on a small corpus: what each stage drops, and the shape of what it returns."""

import random

import pytest

import corpus_pipeline
from turnloom.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800)]

    def line(n=12):
        return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."

    def document():
        return "\n".join(line(rng.randint(10, 18)) for _ in range(rng.randint(4, 9)))

    shared = line(14)
    docs = [document() for _ in range(260)]
    docs += [document() + "\n" + shared for _ in range(6)]                      # 260-265: a line to drop
    docs += [docs[3], docs[3] + " more", docs[4]]                              # 266-268: near copies
    item = line(30)
    docs += [document() + "\n" + item]                                         # 269: benchmark
    docs += ["###".join(document().split(" ")) for _ in range(3)]              # 270-272: symbols
    docs += ["few words", None, ""]                                            # 273-275
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id LONG, text STRING").write.parquet(f"{path}/benchmark.parquet")
    return str(path), shared


def test_stages(spark, folder, tmp_path):
    path, shared = folder
    docs = queries.table(spark, path, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "encode":
            assert docs.columns == columns
        if name == "line_dedup":
            lines = {r.doc_id: r for r in docs.collect()}
            assert [i for i in range(260, 266) if shared in lines[i].text.split("\n")] == [265]
            assert all(r.n_chars == len(r.text) for r in lines.values())
    assert kept["quality_rules"] == set(range(270))
    assert kept["line_dedup"] == kept["quality_rules"]
    assert kept["near_dedup"] == set(range(270)) - {266, 267, 268}
    assert kept["decontamination"] == kept["encode"] == kept["near_dedup"] - {269}
    whole = {tuple(r) for r in corpus_pipeline.run(spark, path).collect()}
    assert whole == {tuple(r) for r in docs.collect()}


def test_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    docs = queries.table(spark, path, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
