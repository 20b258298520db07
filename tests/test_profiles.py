import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from turnloom.operators import drift, entities, profile, topics, turns
from turnloom.plans import drift as plan


def test_turns_strict_and_lenient(spark):
    raw = " user 1 : hello \nno prefix\nUSER 22:bye\r\nUser 3:   \n\nUser x: no"
    df = spark.createDataFrame([(5, raw, 2)], "conversation_id BIGINT, raw STRING, day INT")
    assert [tuple(r) for r in turns.explode_turns(df, ["day"]).collect()] == [
        (5, 2, 0, 1, "hello"), (5, 2, 1, 22, "bye")]
    assert [r.text for r in turns.explode_lines(df).collect()] == ["hello", "no prefix", "bye", "User x: no"]


def test_chunks_both_ways(spark):
    raws = [(1, 0, "User 1: a b\nUser 2: good\nUser 1: c"), (2, 3, "User 7: alone"), (3, 3, "nobody")]
    df = spark.createDataFrame(raws, "conversation_id BIGINT, day INT, raw STRING")
    direct = sorted(turns.dialogue_chunks(df).collect())
    paired = sorted(turns.turn_pair_chunks(turns.explode_turns(df, ["day"])).collect())
    assert direct == paired
    assert [(r.id, r.text, r.day_bucket) for r in direct] == [
        ("c1_t0", "User 1: a b\nUser 2: good", 0), ("c1_t2", "User 1: c", 0), ("c2_t0", "User 7: alone", 3)]
    assert tuple(turns.chunk_counts(turns.dialogue_chunks(df)).first()) == (3, 0, 3)


def brute_topics(rows, stop, k=10):
    import re
    docs = defaultdict(list)
    for day, _, _, text in sorted(rows):
        docs[day] += [t for t in re.findall(r"\b[a-zA-Z][a-zA-Z']+\b", text.lower()) if t not in stop]
    tf = {d: Counter(toks) + Counter(" ".join(p) for p in zip(toks, toks[1:])) for d, toks in docs.items()}
    df = Counter(term for c in tf.values() for term in c)
    n = len({r[0] for r in rows})
    out = {}
    for day, counts in tf.items():
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in counts.items() if df[t] >= 2}
        norm = math.sqrt(sum(x * x for x in w.values()))
        best = sorted(w, key=lambda t: (round(w[t], 9), t), reverse=True)[:k]
        out[day] = [(t, round(w[t] / norm, 4)) for t in best]
    return out


ROWS = [(0, 1, 0, "apple pie is great"), (0, 1, 1, "the pie, the cake"), (0, 2, 0, "a"), (0, 3, 0, "cake apple"),
        (0, 90, 0, "great cake don't"), (1, 100, 0, "apple pie the cake"), (1, 101, 0, "cake"), (1, 101, 1, "pie great"),
        (1, 140, 7, "don't apple"), (2, 150, 0, "pie cake great apple"), (2, 151, 0, "zebra zebra")]


@pytest.mark.parametrize("block,widest", [(65_536, 64), (2, 64), (4, 0)])
def test_topics_against_brute_force(spark, monkeypatch, block, widest):
    monkeypatch.setattr(topics, "_BLOCK", block)
    counts_by_term = topics._counts_by_term
    monkeypatch.setattr(topics, "_counts_by_term", lambda terms, days, least: counts_by_term(terms, days, least, widest))
    df = spark.createDataFrame(ROWS, "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    got = defaultdict(list)
    for r in sorted(topics.top_topics(df, stop_words=["the", "is"]).collect(), key=lambda r: (r.day, r.rank)):
        got[r.day].append((r.term, r.score))
    assert dict(got) == brute_topics(ROWS, {"the", "is"})


def test_topic_positions_with_huge_ids(spark, monkeypatch):
    monkeypatch.setattr(topics, "_BLOCK", 4)
    shifted = [(d, c * 2**40 + 7, t * 2**20, x) for d, c, t, x in ROWS]
    schema = "day INT, conversation_id BIGINT, turn_index BIGINT, text STRING"
    plain = topics.term_counts(spark.createDataFrame(ROWS, schema.replace("turn_index BIGINT", "turn_index INT")), ["the"])
    wide = topics.term_counts(spark.createDataFrame(shifted, schema), ["the"])
    assert sorted(plain.collect()) == sorted(wide.collect())


def test_one_day_has_no_topics(spark):
    df = spark.createDataFrame(ROWS[:3], "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    assert topics.top_topics(df, stop_words=[]).count() == 0


def test_concentration_counts_whole_words(spark):
    df = spark.createDataFrame([(0, 1, 0, "Pie pies pie-pie"), (0, 2, 0, "épie xpie"), (1, 3, 0, "pie")],
                               "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    found = topics.topic_concentration(df, topics.top_topics(df, stop_words=[]))
    assert {(r.day, r.term): (r["count"], r.distinct_convos) for r in found.collect()}[(0, "pie")] == (3, 1)


def test_mentions_prefer_longer_matches(spark):
    gaz = spark.createDataFrame([("Harry Potter", "PERSON"), ("Potter", "ORG"), ("Comic Con", "EVENT"), ("Potter Comic", "GPE"),
                                 ("New York City", "GPE"), ("York", "GPE"), ("I", "PERSON"), ("They", "ORG"), ("May", "DATE")],
                                "surface STRING, label STRING")
    text = "Harry Potter met Potter in New York City. Harry, Potter Comic Con! They I May McPotter"
    df = spark.createDataFrame([(0, 1, 0, text)], "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    found = entities.gazetteer_mentions(df, gaz)
    assert Counter(r.entity for r in found.collect()) == Counter(
        {"Harry Potter": 1, "Potter": 1, "New York City": 1, "Potter Comic": 1, "Comic Con": 1, "They": 1, "I": 1, "May": 1})
    kept = entities.keep_mentions(found, ["PERSON", "ORG", "GPE", "EVENT"], ["i", "you", "we", "they"])
    assert {"They", "I", "May"} & {r.entity for r in kept.collect()} == set()


def mention(spark, rows):
    return spark.createDataFrame(rows, "day INT, conversation_id BIGINT, turn_index INT, run INT, start INT, "
                                       "entity STRING, label STRING, compound DOUBLE")


def test_entity_counts_and_rollup(spark):
    rows = [(0, 1, 0, 0, 0, "Ann", "PERSON", 0.5), (0, 1, 1, 0, 0, "Ann", "ORG", -0.5), (0, 2, 0, 0, 0, "Bob", "PERSON", 0.1),
            (0, 2, 0, 1, 0, "Bob", "PERSON", 0.1), (1, 3, 0, 0, 0, "Ann", "PERSON", 0.0), (2, 3, 1, 0, 0, "Ann", "ORG", 1.0)]
    top = sorted(entities.top_entities(mention(spark, rows)).collect(), key=lambda r: (r.day, r.rank))
    assert [(r.day, r.text, r.label, r["count"], r.distinct_convos) for r in top][:2] == [
        (0, "Ann", "ORG", 2, 1), (0, "Bob", "PERSON", 2, 1)]
    rolled = {r.entity: r for r in entities.entity_rollup(mention(spark, rows)).collect()}
    assert rolled["Ann"].label == "ORG"  # two each: alphabetical
    assert rolled["Ann"].sentiment_variance == pytest.approx(0.3125)
    assert (rolled["Ann"].distinct_day_buckets, rolled["Ann"].concentration_ratio) == (3, 0.5)
    assert rolled["Bob"].sentiment_variance == pytest.approx(0.0)
    assert entities.contradiction_candidates(entities.entity_rollup(mention(spark, rows))).count() == 0
    best = entities.contradiction_candidates(entities.entity_rollup(mention(spark, rows)), concentration_min=0.4)
    assert [r.entity for r in best.collect()] == ["Ann"]


TOPICS = "array<struct<term:string,score:double,count:bigint,distinct_convos:bigint>>"
ENTITIES = "array<struct<text:string,label:string,count:bigint,distinct_convos:bigint>>"


def profiles(spark, rows):
    schema = f"day INT, avg_compound DOUBLE, mood STRING, tone STRING, top_topics {TOPICS}, top_entities {ENTITIES}"
    return spark.createDataFrame(rows, schema)


def test_drift_of_published_days(spark):
    same = [("love", 0.5, 9, 9)]
    published = [(0.5238, "playful", 0.0), (0.5198, "happy", 0.1036), (0.5225, "happy", 0.0024), (0.5251, "happy", 0.0023),
                 (0.5257, "happy", 0.0005), (0.5161, "playful", 0.1086), (0.515, "playful", 0.001)]
    df = profiles(spark, [(i, c, m, "casual", same, []) for i, (c, m, _) in enumerate(published)])
    found = sorted(drift.detect_drift(df).collect())
    assert [r.drift_score for r in found] == [s for _, _, s in published]
    assert [r.day for r in found if r.drift_from_prev] == [1, 5]
    assert found[0].topic_jaccard == 1.0 and found[5].sentiment_delta == 0.0096


def test_triggers(spark):
    rows = [
        (0, 0.0, "neutral", "casual", [("old", .5, 10, 2)], [("Ann", "PERSON", 10, 2)]),
        (1, 0.5, "happy", "casual", [("old", .5, 10, 2), ("new", .4, 10, 2)], [("Ann", "PERSON", 10, 2)]),
        (2, 0.0, "neutral", "casual", [("new", .9, 10, 2)],
         [("Bo", "GPE", 9, 2), ("Cy", "ORG", 20, 5), ("Di", "ORG", 9, 4), ("Ed", "ORG", 10, 4), ("Fy", "ORG", 8, 4)]),
        (3, 0.0, "neutral", "casual", [("new", .9, 10, 2)], [("Gus", "GPE", 90, 1)]),
        (4, 0.9, "happy", "casual", [("new", .9, 10, 2)], [])]
    df = profiles(spark, rows)
    found = {r.day: r.trigger for r in drift.find_triggers(df, drift.detect_drift(df)).collect()}
    assert set(found) == {1, 2}
    assert (found[1].kind, found[1].value, found[1].score, found[1].label) == ("topic", "new", .4, None)
    assert (found[2].kind, found[2].value, found[2].concentration) == ("entity", "Ed", 0.6)
    assert [a.value for a in found[2].alternatives] == ["Bo", "Di"]
    line = drift.timeline(df.withColumn("features", F.struct(F.lit(1).alias("x"))))
    summary = {r.day: r for r in drift.timeline_summary(line).collect()}
    assert summary[4].trigger is None and summary[4].top_entities == []
    assert len(summary[2].top_entities) == 5
    assert tuple(drift.sentiment_range(df).first()) == (0.0, 0.9)


def test_timeline_end_to_end(spark):
    gaz = spark.createDataFrame([("Paris", "GPE")], "surface STRING, label STRING")
    rows = [(r[0], r[1], r[2], r[3] + " in Paris!") for r in ROWS]
    df = spark.createDataFrame(rows, "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    out = sorted(plan.drift_timeline(df, gaz, stop_words=["the"]).collect(), key=lambda r: r.day)
    assert [r.day for r in out] == [0, 1, 2]
    assert all(0 <= r.drift_score <= 1 for r in out)
    assert out[0].top_entities[0].text == "Paris" and not out[0].drift_from_prev


def test_rollup_is_one_row_per_day(spark):
    df = spark.createDataFrame([(0, 1, 0, "WOW it's good!"), (0, 1, 1, "no?"), (1, 2, 0, "")],
                               "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    rows = {r.day: r for r in profile.daily_rollup(profile.scored_turns(df)).collect()}
    assert (rows[0].n_turns, rows[0].n_conversations) == (2, 1)
    assert (rows[0].question_rate, rows[0].caps_ratio, rows[0].contraction_rate) == (0.25, 0.25, 0.25)
    assert rows[1].avg_word_len == 0.0


def test_rollup_counts_any_number_of_days_and_the_labels_there_are(spark):
    rows = [(day, day % 40, 0, 0, 0, "Ann", "EVENT" if day % 3 else "GPE", 0.1) for day in range(130)] + [
        (None, 1, 1, 0, 0, "Ann", "GPE", 0.1), (0, 1, 0, 0, 0, None, "ORG", 0.2)]
    rolled = {r.entity: r for r in entities.entity_rollup(mention(spark, rows)).collect()}
    assert (rolled["Ann"].distinct_day_buckets, rolled["Ann"].label, rolled["Ann"].total_mentions) == (130, "EVENT", 131)
    assert rolled[None].label == "ORG"


def test_a_null_day_is_no_day(spark):
    rows = [(None, 0.9, "happy", "formal", [], []), (0, 0.1, "neutral", "casual", [], []), (1, 0.1, "neutral", "casual", [], [])]
    changes = {r.day: r for r in drift.detect_drift(profiles(spark, rows)).collect()}
    assert sorted(changes) == [0, 1] and not changes[0].drift_from_prev and changes[0].drift_score == 0
    turns = spark.createDataFrame([(None, 1, 0, "stray words here"), (0, 1, 1, "good words here"), (1, 2, 0, "good words there")],
                                  "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    assert {r.day for r in topics.top_topics(turns, stop_words=()).collect()} == {0, 1}
    assert "stray" not in {r.term for r in topics.term_counts(turns, stop_words=()).collect()}


def test_terms_of_many_days_are_counted_in_narrow_rows(spark):
    rows = [(day, f"t{n}") for day in range(40) for n in range(0, 60, day + 1)]
    terms = spark.createDataFrame(rows, "day INT, term STRING")
    counted = topics._counts_by_term(terms, list(range(40)), 2)
    assert "d39" not in counted._jdf.queryExecution().optimizedPlan().toString()  # no counter a day
    days = {}
    for day, term in rows:
        days.setdefault(term, set()).add(day)
    assert sorted(tuple(r) for r in counted.select("day", "term", "tf", "df").collect()) == sorted(
        (day, term, 1, len(days[term])) for day, term in rows if len(days[term]) > 1)


def test_top_topics_reads_counts_that_are_stored(spark):
    # Ties at the last place, and a day with fewer terms than places.
    rows = [(0, 1, 0, "aa xx bb xx cc xx dd"), (0, 2, 0, "aa"), (1, 3, 0, "aa xx bb xx cc xx dd"), (2, 4, 0, "dd"), (None, 5, 0, "aa")]
    turns = spark.createDataFrame(rows, "day INT, conversation_id BIGINT, turn_index INT, text STRING")
    top = topics.top_topics(turns, k=2, stop_words=["xx"])
    assert any("term-counts" in name for name in top.inputFiles())
    assert sorted((r.day, r.rank, r.term) for r in top.collect()) == [(0, 1, "aa"), (0, 2, "cc dd"), (1, 1, "cc dd"), (1, 2, "cc"), (2, 1, "dd")]
