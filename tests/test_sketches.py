"""Mergeable distinct counts against exact ones."""

import pytest
from pyspark.sql import functions as F

from turnloom.operators import entities, profile, sketches, topics


def _mentions(spark):
    return spark.range(60_000).selectExpr(
        "CAST(id % 7 AS INT) AS day", "id % 21000 AS conversation_id", "0 AS turn_index", "0 AS run", "0 AS start",
        "CASE WHEN id % 3 = 0 THEN 'Ann' WHEN id < 40 THEN 'Bo' ELSE 'Cy' END AS entity", "'PERSON' AS label", "0.5D AS compound")


def test_days_merge(spark):
    mentions = _mentions(spark).unionByName(_mentions(spark).limit(50).withColumn("conversation_id", F.lit(None).cast("bigint")))
    days = sketches.by_period(mentions, ["entity"], "conversation_id")
    found = {r.entity: r for r in sketches.merged(days, ["entity"]).collect()}
    exact = {r.entity: r for r in mentions.groupBy("entity").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("d")).collect()}
    assert set(found) == set(exact)
    for name, row in exact.items():
        assert found[name].n == row.n
        assert found[name].distinct == pytest.approx(row.d, rel=4 * sketches.error(), abs=0)
    assert found["Bo"].distinct == exact["Bo"].d  # small sets are exact
    coarse = sketches.by_period(mentions.filter("day < 3"), ["entity"], "conversation_id", lg=8)
    both = sketches.merged(coarse.unionByName(days.filter("day >= 3")), ["entity"]).filter("entity = 'Ann'").first()
    assert both.distinct == pytest.approx(exact["Ann"].d, rel=4 * sketches.error(8))
    assert sketches.merged(days.limit(0), ["entity"]).count() == 0


def test_option_of_the_exact_operators(spark):
    mentions, near = _mentions(spark), sketches.approximate()
    exact = {r.entity: r for r in entities.entity_rollup(mentions).collect()}
    for r in entities.entity_rollup(mentions, distinct=near).collect():
        assert r.distinct_conversations == pytest.approx(exact[r.entity].distinct_conversations, rel=4 * sketches.error())
        assert r.distinct_day_buckets == exact[r.entity].distinct_day_buckets
    tops = [{(r.day, r.text): r.distinct_convos for r in entities.top_entities(mentions, **option).collect()}
            for option in ({}, {"distinct": near})]
    assert tops[0].keys() == tops[1].keys()
    assert all(tops[1][k] == pytest.approx(v, rel=4 * sketches.error()) for k, v in tops[0].items())
    turns = spark.createDataFrame([(0, 1, 0, "the cat", 0.1), (0, 1, 1, "a cat", 0.1), (0, None, 0, "cat", 0.1), (1, None, 0, None, 0.0)],
                                  "day INT, conversation_id BIGINT, turn_index INT, text STRING, compound DOUBLE")
    assert {r.day: r.n_conversations for r in profile.daily_rollup(turns, distinct=near).collect()} == {0: 1, 1: 0}
    terms = spark.createDataFrame([(0, 1, "cat", 1.0)], "day INT, rank INT, term STRING, score DOUBLE")
    row = topics.topic_concentration(turns, terms, distinct=near).first()
    assert (row["count"], row.distinct_convos) == (3, 1)
