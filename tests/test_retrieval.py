import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.operators import answers, conflicts, ranking, vectors
from turnloom.plans import retrieval as plan
from turnloom.sources import tables


def brute(queries, vecs, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    return {(q, i + 1): key for q, qv in queries for i, (_, key) in enumerate(
        sorted((-round(float(unit(qv) @ unit(v)), 12), key) for key, v in vecs)[:k])}


@pytest.mark.parametrize("block", [2048, 2])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "MAX_QUERIES", block)
    rng = np.random.default_rng(2)
    distinct = [(f"v{i:03d}", rng.normal(size=8).tolist()) for i in range(60)]
    vecs = distinct + [(f"copy{i:02d}", distinct[0][1]) for i in range(40)]  # a third are copies
    queries = [(q, rng.normal(size=8).tolist()) for q in range(4)] + [(9, distinct[0][1])]
    v = spark.createDataFrame(vecs, "id STRING, embedding ARRAY<DOUBLE>").repartition(5)
    q = spark.createDataFrame(queries, "qid BIGINT, embedding ARRAY<DOUBLE>")
    found = {(r.qid, r.cosine_rank): r.id for r in vectors.top_k(q, v, 7).collect()}
    assert found == brute(queries, vecs, 7)
    assert vectors.top_k(q, v.limit(3), 7).count() == 15
    assert vectors.top_k(q.limit(0), v, 7).count() == 0


def test_approximate_search_finds_the_vector_itself(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.normal(size=(50, 6)))]
    v = spark.createDataFrame(vecs, "id BIGINT, embedding ARRAY<DOUBLE>")
    best = vectors.approximate_top_k(vecs[3][1], v, 1).first()
    assert best.id == 3 and best.cosine == pytest.approx(1.0)


# day, sentiment, cosine, scaled cosine, score of published answers
PUBLISHED = [(4, .866, .520, 1.0, .873), (5, .953, .487, .533, .707), (5, .402, .502, .751, .706),
             (3, .886, .494, .629, .642), (6, .735, .460, .138, .516)]


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid BIGINT, id STRING, cosine DOUBLE, cosine_rank INT, day_bucket INT, sentiment DOUBLE")


def test_composite_score_of_published_rows(spark):
    low = .520 - (.520 - .460) / (1 - .138)
    rows = [(0, f"h{i}", c, i + 1, d, s) for i, (d, s, c, _, _) in enumerate(PUBLISHED)] + [(0, "low", low, 6, 0, 0.0)]
    ranked = {r.id: r for r in ranking.rerank(hits(spark, rows)).collect()}
    for i, (_, _, _, norm, score) in enumerate(PUBLISHED):
        assert ranked[f"h{i}"].score == pytest.approx(score, abs=0.012)
        assert ranked[f"h{i}"].rank == i + 1


def test_constant_cosines_and_ties(spark):
    rows = [(1, "a", .3, 1, 2, .5), (1, "b", .3, 2, 2, -.5), (1, "c", .3, 3, None, None)]
    ranked = sorted(ranking.rerank(hits(spark, rows)).collect(), key=lambda r: r.rank)
    assert [(r.id, r.cosine_norm) for r in ranked] == [("a", 1.0), ("b", 1.0), ("c", 1.0)]
    assert ranked[2].score == 0.5


def test_ablation(spark):
    rows = [(1, f"x{i}", 1 - i / 20, i + 1, 6 * (i == 6), 0.0) for i in range(7)]
    ranked = ranking.rerank(hits(spark, rows))
    changed = ranking.top_changes(ranked).first()
    assert (changed.gained, changed.dropped) == (["x6"], ["x4"])
    assert tuple(ranking.ablation_summary(ranked).first()) == (1, 7, 4)


def top(spark, rows):
    return spark.createDataFrame(rows, "qid BIGINT, rank INT, id STRING, day_bucket INT, sentiment DOUBLE, text STRING, "
                                       "cosine_sim DOUBLE, synthetic BOOLEAN")


ROWS = [(1, 1, "a", 3, .5, "User 1: I have two sisters at home", .6, False),
        (1, 2, "b", 1, .5, "User 2: I have one sister here", .5, True),
        (1, 3, "c", 3, .5, "User 1: my sister sings in the choir", .4, False),
        (2, 1, "d", 2, .5, "User 1: my sister and nothing else", .9, False),
        (2, 2, "e", 2, .4, "User 1: sister sister all day long", .9, False)]


def test_pairs_and_answers(spark):
    ranked = top(spark, ROWS)
    pairs = conflicts.top_pairs(ranked)
    assert sorted((r.qid, r.a_id, r.b_id) for r in pairs.collect()) == [
        (1, "a", "b"), (1, "a", "c"), (1, "b", "c"), (2, "d", "e")]

    def model(df):  # a stand-in for a model: certain about one pair only
        sure = (F.col("a_id") == "a") & (F.col("b_id") == "b")
        return df.withColumns({"contradiction_prob": F.when(sure, 0.9).otherwise(0.6), "entailment_prob": F.lit(0.05),
                               "neutral_prob": F.when(sure, 0.05).otherwise(0.35)})

    scored = conflicts.score_pairs(pairs, model)
    assert [(r.a_id, r.b_id) for r in conflicts.flagged_pairs(scored).collect()] == [("a", "b")]
    queries = spark.createDataFrame([(1, "about my sister", None), (2, "q", "your sister"), (3, "about cats", None)],
                                    "qid BIGINT, query STRING, entity STRING")
    found = {r.qid: r for r in answers.assemble(queries, ranked, scored).collect()}
    assert found[1].answer == (
        "You've mentioned sister across 3 occasions over day-buckets 1–3. "
        'Earlier (day-bucket 1): "I have one sister here". Later (day-bucket 3): "I have two sisters at home". ' + K.NOTE_FACTS)
    assert found[1].confidence == pytest.approx(0.5 * 0.85) and len(found[1].contradictions) == 1
    assert found[2].answer == (
        "You've mentioned your sister across 2 occasions over day-bucket 2. "
        'Earlier (day-bucket 2): "my sister and nothing else". Later (day-bucket 2): "sister sister all day long". '
        + K.NOTE_CONSISTENT)
    assert found[3].answer is None and found[3].confidence == 0.0
    assert {r.qid: r.n_synthetic for r in answers.synthetic_hits(answers.assemble(queries, ranked, scored)).collect()} == {
        1: 1, 2: 0, 3: 0}
    assert "source_chunks" not in answers.without_sources(answers.assemble(queries, ranked, scored)).columns


def test_rule_scores(spark):
    ranked = top(spark, [(1, 1, "a", 0, .5, "we have two dogs", 0.1, False), (1, 2, "b", 0, .5, "we have three dogs", .1, False),
                         (1, 3, "c", 0, .5, "we have two dogs", .1, False), (1, 4, "d", 0, -.5, "rain again", .1, False)])
    scored = {(r.a_id, r.b_id): r for r in conflicts.score_pairs(conflicts.top_pairs(ranked)).collect()}
    assert scored[("a", "c")].verdict == "entailment"
    assert scored[("b", "d")].verdict == "contradiction" and scored[("b", "d")].flagged
    for r in scored.values():
        assert r.contradiction_prob + r.entailment_prob + r.neutral_prob == pytest.approx(1, abs=2e-4)


def test_seeds(spark):
    seeds = tables.seed_chunks(spark)
    pairs = conflicts.score_pairs(conflicts.seed_pairs(seeds))
    assert pairs.count() == 3
    assert {r.day_bucket for r in seeds.collect()} == {1, 4, 6}


def test_seed_pairs_in_blocks(spark, monkeypatch):
    rows = [(f"s{i % 29:02d}", f"text {i}", None if i == 3 else i % 4, 0.1) for i in range(31)]  # two ids repeat
    seeds = spark.createDataFrame(rows, "id STRING, text STRING, day_bucket INT, sentiment DOUBLE").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
    wanted = [(i + 1, j + 1, a[1], b[1]) for i, a in enumerate(ordered) for j, b in enumerate(ordered) if i < j]
    for size in (1, 4, 31, 512):
        monkeypatch.setattr(conflicts, "BLOCK_SEEDS", size)
        found = conflicts.seed_pairs(seeds).select("a_rank", "b_rank", "a_text", "b_text").collect()
        assert sorted(map(tuple, found)) == wanted
    assert conflicts.seed_pairs(seeds.limit(0)).count() == 0
    assert conflicts.seed_pairs(seeds.limit(1)).count() == 0


def test_resolve_demo_queries(spark):
    """Seed chunks among others, the default encoder and the demonstration questions."""
    other = spark.createDataFrame([(f"c{i}_t0", f"User 1: the weather report number {i} says rain", i, 0, i % 7, 0.0, False)
                                   for i in range(20)], tables.CHUNK_SCHEMA)
    index, encoder = plan.index_chunks(plan.build_chunks(other, tables.seed_chunks(spark)), 128)
    out = plan.resolve(tables.demo_queries(spark), index, encoder, k=5).collect()
    assert len(out) == 3
    for r in out:
        assert r.source_chunks and 0 <= r.confidence <= 1 and len(r.contradictions or []) <= 10
        assert any(c.synthetic for c in r.source_chunks)
        assert r.answer.startswith("You've mentioned your sister across 5 occasions")


def test_null_vectors_are_passed_over(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id LONG, embedding ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid LONG, embedding ARRAY<DOUBLE>")
    assert [(r.qid, r.id) for r in vectors.top_k(asked, df, 5).orderBy("qid", "cosine_rank").collect()] == [(1, 1), (1, 3)]


def test_a_callers_own_encoder(spark):
    chunks = spark.createDataFrame([(f"c{i}", word * 3, i, 0, i % 7, 0.0, False) for i, word in enumerate(("aaa ", "bbb ", "ab "))],
                                   tables.CHUNK_SCHEMA)

    def letters(rows):
        count = [(F.length("text") - F.length(F.regexp_replace("text", c, ""))).cast("double") for c in "ab"]
        return rows.withColumn("embedding", F.array(*count))

    index, encoder = plan.index_chunks(chunks, encoder=letters)
    assert encoder is letters
    asked = spark.createDataFrame([(1, "bbbb", "x"), (2, "aaaa", "x")], "qid LONG, query STRING, entity STRING")
    ranked = plan.search(plan.encoded(asked.withColumn("text", F.col("query")), encoder), index, 1).collect()
    assert {r.qid: r.id for r in ranked} == {1: "c1", 2: "c0"}
    assert plan.resolve(asked, index, encoder, k=2).count() == 2
