"""Turns, periods, sentiment, profiles, topics, entities and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import inputs as I
from suite import sqlparts as Q
from turnloom import constants as K
from turnloom.functions import sentiment, style
from turnloom.functions import text as T
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import binning, drift, entities, profile, sketches, tagger, topics
from turnloom.operators import turns as turn_ops
from turnloom.plans import drift as drift_plan
from turnloom.plans import entities as entity_plan
from turnloom.scaling import spread, stored

DEFAULT = Lexicon()


# --- turns ----------------------------------------------------------------------

def turns_strict(spark, sf):
    return turn_ops.explode_turns(I.dialogues(spark, sf))  # numbered within each dialogue


def turns_lenient(spark, sf):
    lines = turn_ops.explode_lines(I.dialogues(spark, sf))
    return lines.groupBy("text").agg(F.count("*").alias("n"))


def turn_days(spark, sf):
    days = I.turns(spark, sf).select("conversation_id", "day").distinct()
    turns = I.plain_turns(spark, sf)
    return turn_ops.attach_days(turns, days).groupBy("day", "speaker").agg(
        F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"))


SQL_LINES = r"""
lines AS (SELECT conversation_id, unnest(l) AS line, unnest(range(len(l))) AS i
          FROM (SELECT conversation_id, string_split(raw, chr(10)) AS l FROM dialogues))"""
SQL_STRICT = f"""WITH {I.SQL_DIALOGUES}, {SQL_LINES},
kept AS (
  SELECT conversation_id, i, CAST(regexp_extract(line, '(?i)^\\s*User\\s*([0-9]+)\\s*:\\s*', 1) AS INTEGER) AS speaker,
         trim(regexp_replace(line, '(?i)^\\s*User\\s*[0-9]+\\s*:\\s*', '')) AS text
  FROM lines WHERE regexp_matches(line, '(?i)^\\s*User\\s*([0-9]+)\\s*:\\s*'))
SELECT conversation_id,
       CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY i) - 1 AS INTEGER) AS turn_index, speaker, text
FROM kept WHERE text <> ''"""
SQL_LENIENT = f"""WITH {I.SQL_DIALOGUES}, {SQL_LINES},
kept AS (SELECT trim(regexp_replace(line, '(?i)^\\s*User\\s*[0-9]+\\s*:\\s*', '')) AS text FROM lines)
SELECT text, count(*) AS n FROM kept WHERE text <> '' GROUP BY text"""
SQL_TURN_DAYS = f"""WITH {I.SQL_TURNS}
SELECT day, speaker, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM turns GROUP BY ALL"""


# --- periods --------------------------------------------------------------------

def bin_rows(spark, sf):
    customers = I.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return binning.bin_by_rows(customers, 7, "c_custkey")


def bin_session(spark, sf):
    """Users in order of their first event."""
    events = I.table(spark, sf, "events").select("event_id", "user_id")
    return binning.bin_by_session(events, 7, "user_id", "event_id")


def bin_rows_composite(spark, sf):
    """Events in order of time, equal times by id."""
    events = I.table(spark, sf, "events").select("event_id", "ts")
    return binning.bin_by_rows(events, 7, ["ts", "event_id"]).select("event_id", "day")


def _string_sessions(spark, sf):
    session = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    return I.table(spark, sf, "events").select("event_id", "ts", session.alias("session_id"))


def bin_session_string(spark, sf):
    """Sessions in order of their own string id."""
    return binning.bin_by_session(_string_sessions(spark, sf), 7).select("event_id", "session_id", "day")


def bin_session_first_seen(spark, sf):
    """Sessions with a string id in order of their first event by time and id."""
    binned = binning.bin_by_session(_string_sessions(spark, sf), 7, order_by=["ts", "event_id"])
    return binned.select("event_id", "session_id", "day")


def bin_timestamp(spark, sf):
    events = I.table(spark, sf, "events").select("event_id", "ts")
    return binning.bin_by_timestamp(events, 7).select("event_id", "day")


def assign_days(spark, sf):
    """Strategy chosen from the schema: rows per day with how the days were made."""
    turns, info = binning.assign_days(I.plain_turns(spark, sf))
    return turns.groupBy("day").agg(F.count("*").alias("n")).select(
        "day", "n", *[F.lit(getattr(info, f)).alias(f) for f in ("strategy", "reason", "n_bins", "chronology")])


SQL_BIN_ROWS = """
SELECT c_custkey, c_acctbal,
       CAST((row_number() OVER (ORDER BY c_custkey) * 7 - 1) // count(*) OVER () AS INTEGER) AS day FROM customer"""
SQL_BIN_SESSION = """
WITH s AS (SELECT user_id, min(event_id) AS first_row FROM events GROUP BY user_id),
d AS (SELECT user_id, CAST((row_number() OVER (ORDER BY first_row) * 7 - 1) // count(*) OVER () AS INTEGER) AS day FROM s)
SELECT event_id, user_id, day FROM events JOIN d USING (user_id)"""
SQL_BIN_ROWS_COMPOSITE = """
SELECT event_id, CAST((row_number() OVER (ORDER BY ts, event_id) * 7 - 1) // count(*) OVER () AS INTEGER) AS day FROM events"""
SQL_BIN_SESSION_STRING = """
WITH e AS (SELECT event_id, event_type || '/' || user_id AS session_id FROM events),
d AS (SELECT session_id, CAST((row_number() OVER (ORDER BY session_id) * 7 - 1) // count(*) OVER () AS INTEGER) AS day
      FROM (SELECT DISTINCT session_id FROM e))
SELECT event_id, session_id, day FROM e JOIN d USING (session_id)"""
SQL_BIN_SESSION_FIRST_SEEN = """
WITH e AS (SELECT event_id, event_type || '/' || user_id AS session_id, row_number() OVER (ORDER BY ts, event_id) AS place
           FROM events),
d AS (SELECT session_id, CAST((row_number() OVER (ORDER BY min(place)) * 7 - 1) // count(*) OVER () AS INTEGER) AS day
      FROM e GROUP BY session_id)
SELECT event_id, session_id, day FROM e JOIN d USING (session_id)"""
SQL_BIN_TIMESTAMP = f"WITH {I.SQL_UTTERANCES} SELECT turn_index AS event_id, day FROM turns"
SQL_ASSIGN = f"""WITH {I.SQL_TURNS}
SELECT day, count(*) AS n, 'session' AS strategy, 'found grouping column ''conversation_id''' AS reason,
       CAST(7 AS INTEGER) AS n_bins, 'session_order:conversation_id' AS chronology FROM turns GROUP BY day"""


# --- text, style and sentiment --------------------------------------------------

def surface_features(spark, sf):
    features = style.surface_features(F.col("text"))
    return I.documents(spark, sf).select(
        "doc_id", *[(F.round(c, 4) if "_r" in n or "avg" in n else c).alias(n) for n, c in features.items()])


def utterance_features(spark, sf):
    counts = style.counts(F.col("text"))
    return I.utterances(spark, sf).select(
        F.col("turn_index").alias("event_id"), *[c.alias(n) for n, c in counts.items()],
        T.word_count(F.col("text")).alias("n_tokens"), T.first_token(F.col("text")).alias("first_token"))


def clean_text(spark, sf):
    return I.documents(spark, sf).select(
        "doc_id", T.clean(F.col("text")).alias("cleaned"), T.clean_preserve_case(F.col("text")).alias("cased"))


def sentiment_turns(spark, sf):
    return profile.scored_turns(I.turns(spark, sf), I.LEXICON).select(
        "conversation_id", "turn_index", "day", "compound")


def sentiment_utterances(spark, sf):
    return profile.scored_turns(I.utterances(spark, sf)).select(
        F.col("turn_index").alias("event_id"), "compound")


def mood_labels(spark, sf):
    u = I.utterances(spark, sf)
    f = style.surface_features(F.col("text"))
    compound = sentiment.compound(F.col("text"))
    scored = u.select("turn_index", compound.alias("compound"), *[c.alias(n) for n, c in f.items()])
    mood = style.mood_label(F.col("compound"), F.col("exclaim_rate"), F.col("caps_ratio"),
                            F.col("avg_word_len"), F.col("question_rate"))
    return scored.select(F.col("turn_index").alias("event_id"), mood.alias("mood"),
                         sentiment.sign(F.col("compound")).alias("sign"))


SQL_SURFACE = f"""
WITH f AS (SELECT doc_id, {Q.style_columns()} FROM documents)
SELECT doc_id, n_chars, n_words, round(n_question / greatest(n_words, 1), 4) AS question_rate,
       round(n_exclaim / greatest(n_words, 1), 4) AS exclaim_rate, round(n_caps / greatest(n_words, 1), 4) AS caps_ratio,
       round(n_word_chars / greatest(n_words, 1), 4) AS avg_word_len FROM f"""
SQL_UTTERANCE_FEATURES = f"""WITH {I.SQL_UTTERANCES}
SELECT turn_index AS event_id, {Q.style_columns()},
       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> ''))::INTEGER AS n_tokens,
       regexp_split_to_array(lower(text), '[\\s,.!?]+')[1] AS first_token FROM turns"""
SQL_SENTIMENT_TURNS = f"""WITH {I.SQL_TURNS}, {Q.sentiment(I.LEXICON, 'turns', 'conversation_id, turn_index')}
SELECT conversation_id, turn_index, day, compound FROM turns JOIN scored USING (conversation_id, turn_index)"""
SQL_SENTIMENT_UTTERANCES = f"""WITH {I.SQL_UTTERANCES}, {Q.sentiment(DEFAULT, 'turns', 'conversation_id, turn_index')}
SELECT turn_index AS event_id, compound FROM scored"""
SQL_MOOD = f"""WITH {I.SQL_UTTERANCES}, {Q.sentiment(DEFAULT, 'turns', 'conversation_id, turn_index')},
f AS (SELECT turn_index, compound, {Q.style_columns()} FROM turns JOIN scored USING (conversation_id, turn_index)),
g AS (SELECT turn_index, compound, n_question / greatest(n_words, 1) AS q, n_word_chars / greatest(n_words, 1) AS wl,
             n_exclaim / greatest(n_words, 1) * 3 + n_caps / greatest(n_words, 1) * 2 AS energy FROM f)
SELECT turn_index AS event_id,
  CASE WHEN compound <= -0.25 AND energy >= 0.6 THEN 'frustrated' WHEN compound <= -0.25 THEN 'down'
       WHEN compound >= 0.25 AND energy >= 0.6 THEN 'playful' WHEN compound >= 0.25 AND energy >= 0.15 THEN 'warm'
       WHEN compound >= 0.25 THEN 'content' WHEN q >= 0.08 THEN 'curious'
       WHEN wl + CASE WHEN q < 0.05 THEN 0.5 ELSE 0 END >= 4.8 THEN 'formal' ELSE 'neutral' END AS mood,
  CASE WHEN compound > 0.05 THEN 'pos' WHEN compound < -0.05 THEN 'neg' ELSE 'neutral' END AS sign FROM g"""


# --- profiles -------------------------------------------------------------------

_ROLLUP = ["day", "n_turns", "n_conversations", "avg_compound", "question_rate", "exclamation_rate", "caps_ratio",
           "avg_word_len", "contraction_rate", "mood", "tone"]


def daily_rollup(spark, sf):
    return profile.daily_rollup(profile.scored_turns(I.turns(spark, sf), I.LEXICON)).select(*_ROLLUP)


def daily_rollup_events(spark, sf):
    return profile.daily_rollup(profile.scored_turns(I.utterances(spark, sf))).select(*_ROLLUP)


def sentiment_range(spark, sf):
    return drift.sentiment_range(daily_rollup(spark, sf))


def _document_turns(spark, sf) -> DataFrame:
    """Documents as one-turn conversations in seven periods by row order."""
    docs = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("conversation_id"), F.lit(0).alias("turn_index"), "text")
    return spread(binning.bin_by_rows(docs, 7, "conversation_id"))


def topics_top(spark, sf):
    return topics.top_topics(_document_turns(spark, sf), stop_words=I.STOP_WORDS)


def topic_concentration(spark, sf):
    turns = I.turns(spark, sf)
    return topics.topic_concentration(turns, topics.top_topics(turns, stop_words=I.STOP_WORDS))


def topic_concentration_events(spark, sf):
    turns = I.utterances(spark, sf)
    return topics.topic_concentration(turns, topics.top_topics(turns, stop_words=I.STOP_WORDS))


def term_counts(spark, sf):
    return topics.term_counts(I.turns(spark, sf), I.STOP_WORDS)


def entity_mentions(spark, sf):
    turns = I.turns(spark, sf).select("day", "conversation_id", "turn_index", "text")
    found = entities.keep_mentions(entities.gazetteer_mentions(turns, I.gazetteer(spark)),
                                   K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS)
    return found.groupBy("day", "conversation_id", "turn_index", "entity", "label").agg(F.count("*").alias("n"))


def entities_top(spark, sf):
    turns = I.turns(spark, sf).select("day", "conversation_id", "turn_index", "text")
    found = entities.keep_mentions(entities.gazetteer_mentions(turns, I.gazetteer(spark)),
                                   K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS)
    return entities.top_entities(found)


def entities_merged(spark, sf):
    """Conversations of each entity from merged sketches of the days, held against the exact count: ``near`` within four errors."""
    turns = I.turns(spark, sf).select("day", "conversation_id", "turn_index", "text")
    mentions = stored(entities.keep_mentions(entities.gazetteer_mentions(turns, I.gazetteer(spark)),
                                             K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS), "mentions")
    days = stored(sketches.by_period(mentions, ["entity"], "conversation_id"), "sketches")
    exact = mentions.groupBy("entity").agg(F.count_distinct("conversation_id").alias("exact"))
    return sketches.merged(days, ["entity"]).join(exact, "entity").select(
        "entity", "n", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= F.lit(4 * sketches.error()) * F.col("exact")).alias("near"))


def entities_tagged(spark, sf):
    """Mentions in all turns by a tagger fitted on the gazetteer's in three turns of four, and its F1 on the fourth."""
    turns = I.turns(spark, sf).select("day", "conversation_id", "turn_index", "text")
    fourth = F.pmod(F.xxhash64("conversation_id", "turn_index"), F.lit(4)) == 2
    gazetteer = I.gazetteer(spark)
    found = stored(tagger.mentions(turns, tagger.fit(turns.filter(~fourth), gazetteer)), "tagged")
    held_out = tagger.agreement(found.filter(fourth), entities.gazetteer_mentions(turns.filter(fourth), gazetteer))
    f1 = held_out.first().f1
    return found.select("day", "conversation_id", "turn_index", F.col("run").alias("place"), "entity", "label",
                        F.lit(f1).cast("double").alias("f1"))


def _scored_mentions(spark, sf):
    return entity_plan.scored_mentions(I.turns(spark, sf), I.gazetteer(spark), I.LEXICON)


def entity_rollup(spark, sf):
    rolled = entities.entity_rollup(_scored_mentions(spark, sf))
    return rolled.withColumns({c: F.round(c, 4) for c in (
        "sentiment_variance", "sentiment_mean", "sentiment_min", "sentiment_max", "concentration_ratio")})


def entity_rollup_wide(spark, sf):
    """The same over 90 periods, with surface forms that carry two labels."""
    turns = I.turns(spark, sf, 90)
    mentions = entities.gazetteer_mentions(turns.select("day", "conversation_id", "turn_index", "text"), I.gazetteer(spark))
    mixed = F.when((F.col("conversation_id") + F.col("turn_index")) % 3 == 0, F.lit("EVENT")).otherwise(F.col("label"))
    rolled = entities.entity_rollup(mentions.withColumn("label", mixed).withColumn("compound", F.col("turn_index") / F.lit(10.0)))
    return rolled.withColumns({c: F.round(c, 4) for c in (
        "sentiment_variance", "sentiment_mean", "sentiment_min", "sentiment_max", "concentration_ratio")})


def sentiment_documents(spark, sf):
    """Every document, with a lexicon of thousands of words."""
    docs = I.documents(spark, sf)
    return docs.select("doc_id", sentiment.compound(F.col("text"), I.LARGE_LEXICON).alias("compound"))


def drift_timeline_gaps(spark, sf):
    """The timeline of events of which one type has no time."""
    return _flat(drift_plan.drift_timeline(I.utterances(spark, sf, "signup"), I.gazetteer(spark), DEFAULT, I.STOP_WORDS))


def contradiction_candidates(spark, sf):
    return entities.contradiction_candidates(entities.entity_rollup(_scored_mentions(spark, sf)),
                                             concentration_min=0.3)


def candidate_record(spark, sf):
    """The stored record: filters, counts and the names of the candidates in order."""
    record = entity_plan.candidate_record(I.turns(spark, sf), I.gazetteer(spark), I.LEXICON, concentration_min=0.3)
    return record.select(
        "info.n_bins", F.array_join("info.entity_labels", ",").alias("entity_labels"), "info.filters.total_mentions_min",
        "info.filters.concentration_ratio_min_exclusive", "info.filters.distinct_day_buckets_min", "info.rank_by",
        "info.n_unique_entities", "info.n_qualified", F.array_join("top.entity", "|").alias("top"))


def candidate_counts(spark, sf):
    return entities.candidate_counts(entities.entity_rollup(_scored_mentions(spark, sf)), concentration_min=0.3)


SQL_ROLLUP = f"WITH {Q.rollup(I.SQL_TURNS, I.LEXICON)} SELECT {', '.join(_ROLLUP)} FROM rollup"
SQL_ROLLUP_EVENTS = f"WITH {Q.rollup(I.SQL_UTTERANCES, DEFAULT)} SELECT {', '.join(_ROLLUP)} FROM rollup"
SQL_RANGE = f"""WITH {Q.rollup(I.SQL_TURNS, I.LEXICON)}
SELECT min(coalesce(avg_compound, 0)) AS min_compound, max(coalesce(avg_compound, 0)) AS max_compound FROM rollup"""
_SQL_DOCUMENT_TURNS = """
turns AS (SELECT doc_id AS conversation_id, 0 AS turn_index, text,
                 CAST((row_number() OVER (ORDER BY doc_id) * 7 - 1) // count(*) OVER () AS INTEGER) AS day FROM documents)"""
SQL_TOPICS = (f"WITH {_SQL_DOCUMENT_TURNS}, {Q.topics(I.STOP_WORDS)} "
              "SELECT day, CAST(rank AS INTEGER) AS rank, term, score FROM top_terms")
_TOPIC_COLUMNS = "SELECT day, rank, term, score, count, distinct_convos FROM topics"
SQL_CONCENTRATION = f"WITH {I.SQL_TURNS}, {Q.topics(I.STOP_WORDS)} {_TOPIC_COLUMNS}"
SQL_CONCENTRATION_EVENTS = f"WITH {I.SQL_UTTERANCES}, {Q.topics(I.STOP_WORDS)} {_TOPIC_COLUMNS}"
SQL_TERM_COUNTS = f"WITH {I.SQL_TURNS}, {Q.topics(I.STOP_WORDS)} SELECT day, term, tf FROM tf"
_SQL_PROFILE_MENTIONS = f"""{I.SQL_TURNS}, {I.SQL_GAZETTEER}, {Q.MENTIONS},
{Q.kept_mentions(K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS)}"""
SQL_MENTIONS = f"""WITH {_SQL_PROFILE_MENTIONS}
SELECT day, conversation_id, turn_index, entity, label, count(*) AS n FROM mentions GROUP BY ALL"""
SQL_ENTITIES = f"WITH {_SQL_PROFILE_MENTIONS}, {Q.TOP_ENTITIES} SELECT * FROM entities"
_SQL_ENTITY_ROLLUP = f"""{I.SQL_TURNS}, {I.SQL_GAZETTEER}, {Q.MENTIONS},
{Q.kept_mentions(K.CANDIDATE_ENTITY_LABELS, K.CANDIDATE_PRONOUNS)},
{Q.sentiment(I.LEXICON, 'turns', 'conversation_id, turn_index')},
rolled AS (
  SELECT entity, min(label) AS label, count(*) AS total_mentions, count(DISTINCT conversation_id) AS distinct_conversations,
         count(DISTINCT day) AS distinct_day_buckets, var_pop(compound) AS sentiment_variance,
         avg(compound) AS sentiment_mean, min(compound) AS sentiment_min, max(compound) AS sentiment_max,
         1.0::DOUBLE - count(DISTINCT conversation_id)::DOUBLE / count(*) AS concentration_ratio
  FROM mentions JOIN scored USING (conversation_id, turn_index) GROUP BY entity),
rounded AS (SELECT * REPLACE (round(sentiment_variance, 4) AS sentiment_variance, round(sentiment_mean, 4) AS sentiment_mean,
   round(sentiment_min, 4) AS sentiment_min, round(sentiment_max, 4) AS sentiment_max,
   round(concentration_ratio, 4) AS concentration_ratio), sentiment_variance AS exact FROM rolled)"""
_QUALIFIED = "total_mentions >= 3 AND concentration_ratio > 0.3 AND distinct_day_buckets >= 3"
SQL_ENTITY_ROLLUP = f"WITH {_SQL_ENTITY_ROLLUP} SELECT * EXCLUDE (exact) FROM rounded"
SQL_ENTITY_ROLLUP_WIDE = f"""WITH {I.SQL_TURNS.replace('* 7 - 1', '* 90 - 1')}, {I.SQL_GAZETTEER}, {Q.MENTIONS},
mentions AS (SELECT * REPLACE (CASE WHEN (conversation_id + turn_index) % 3 = 0 THEN 'EVENT' ELSE label END AS label),
                    turn_index / 10.0::DOUBLE AS compound FROM all_mentions),
labels AS (SELECT entity, label FROM (SELECT entity, label, count(*) AS n FROM mentions GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) = 1)
SELECT entity, any_value(l.label) AS label, count(*) AS total_mentions,
       count(DISTINCT conversation_id) AS distinct_conversations, count(DISTINCT day) AS distinct_day_buckets,
       round(var_pop(compound), 4) AS sentiment_variance, round(avg(compound), 4) AS sentiment_mean,
       round(min(compound), 4) AS sentiment_min, round(max(compound), 4) AS sentiment_max,
       round(1.0::DOUBLE - count(DISTINCT conversation_id)::DOUBLE / count(*), 4) AS concentration_ratio
FROM mentions JOIN labels l USING (entity) GROUP BY entity"""
SQL_SENTIMENT_DOCUMENTS = f"""WITH texts AS (SELECT doc_id, text FROM documents), {Q.sentiment(I.LARGE_LEXICON, 'texts', 'doc_id')}
SELECT doc_id, compound FROM scored"""
SQL_CANDIDATES = f"""WITH {_SQL_ENTITY_ROLLUP}
SELECT * EXCLUDE (exact) FROM rounded WHERE {_QUALIFIED} ORDER BY exact DESC, entity LIMIT 10"""
SQL_CANDIDATE_RECORD = f"""WITH {_SQL_ENTITY_ROLLUP},
top AS (SELECT * FROM rounded WHERE {_QUALIFIED} ORDER BY exact DESC, entity LIMIT 10)
SELECT CAST(7 AS INTEGER) AS n_bins, 'GPE,ORG,PERSON' AS entity_labels, CAST(3 AS INTEGER) AS total_mentions_min,
       0.3::DOUBLE AS concentration_ratio_min_exclusive, CAST(3 AS INTEGER) AS distinct_day_buckets_min,
       'sentiment_variance_desc' AS rank_by, count(*) AS n_unique_entities, count_if({_QUALIFIED})::BIGINT AS n_qualified,
       (SELECT string_agg(entity, '|' ORDER BY exact DESC, entity) FROM top) AS top FROM rolled"""
SQL_CANDIDATE_COUNTS = f"""WITH {_SQL_ENTITY_ROLLUP}
SELECT count(*) AS n_unique_entities, count_if({_QUALIFIED})::BIGINT AS n_qualified FROM rolled"""


# --- drift ----------------------------------------------------------------------

def _timeline(spark, sf, source: str):
    if source == "turns":
        turns, lexicon = I.turns(spark, sf), I.LEXICON
    else:
        turns, lexicon = I.utterances(spark, sf), DEFAULT
    return drift_plan.drift_timeline(turns, I.gazetteer(spark), lexicon, I.STOP_WORDS)


def _flat(timeline: DataFrame) -> DataFrame:
    def names(column, field):
        return F.array_join(F.transform(column, lambda x: x[field]), "|").alias(column)

    return timeline.select(
        "day", "mood", "tone", "avg_compound", "features.question_rate", "features.avg_word_len",
        names("top_topics", "term"), names("top_entities", "text"),
        "drift_from_prev", "drift_score", "drift_detail.sentiment_delta", "drift_detail.topic_jaccard",
        "drift_detail.mood_changed", "drift_detail.tone_changed",
        F.col("trigger.kind").alias("trigger_kind"), F.col("trigger.value").alias("trigger_value"),
        F.col("trigger.count").alias("trigger_count"), F.col("trigger.concentration").alias("trigger_concentration"),
        F.array_join(F.col("trigger.alternatives.value"), "|").alias("trigger_alternatives"))


def drift_timeline(spark, sf):
    return _flat(_timeline(spark, sf, "turns"))


def drift_timeline_events(spark, sf):
    return _flat(_timeline(spark, sf, "events"))


def timeline_summary(spark, sf):
    summary = drift.timeline_summary(_timeline(spark, sf, "turns"))
    return summary.select("day", "mood", "tone", "avg_compound", "drift_score", "drift_from_prev",
                          F.array_join("top_topics", "|").alias("top_topics"),
                          F.array_join("top_entities", "|").alias("top_entities"),
                          F.col("trigger.value").alias("trigger"))


def drift_triggers(spark, sf):
    """Triggers over one conversation per period, where few conversations can dominate a period."""
    turns = I.turns(spark, sf, 40)
    profiles = drift_plan.daily_profiles(turns, I.gazetteer(spark), I.LEXICON, I.STOP_WORDS)
    changes = drift.detect_drift(profiles)
    picked = drift.find_triggers(profiles, changes)
    return picked.select(
        "day", "trigger.kind", "trigger.value", "trigger.label", "trigger.score", "trigger.count",
        "trigger.distinct_convos", "trigger.concentration",
        F.array_join(F.col("trigger.alternatives.value"), "|").alias("alternatives"))


def _sql_flat(source: str, lexicon: Lexicon) -> str:
    return f"""{Q.rollup(source, lexicon)}, {Q.topics(I.STOP_WORDS)}, {I.SQL_GAZETTEER}, {Q.MENTIONS},
{Q.kept_mentions(K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS)}, {Q.TOP_ENTITIES}, {Q.DRIFT}, {Q.TRIGGERS},
topic_names AS (SELECT day, string_agg(term, '|' ORDER BY rank) AS names,
                       string_agg(term, '|' ORDER BY rank) FILTER (rank <= 5) AS five FROM topics GROUP BY day),
entity_names AS (SELECT day, string_agg(text, '|' ORDER BY rank) AS names,
                        string_agg(text, '|' ORDER BY rank) FILTER (rank <= 5) AS five FROM entities GROUP BY day),
alternatives AS (SELECT day, string_agg(value, '|' ORDER BY place) FILTER (place > 1) AS names FROM triggers GROUP BY day),
flat AS (
  SELECT d.day, d.mood, d.tone, d.avg_compound, d.question_rate, d.avg_word_len,
         coalesce(t.names, '') AS top_topics, coalesce(e.names, '') AS top_entities,
         coalesce(t.five, '') AS five_topics, coalesce(e.five, '') AS five_entities,
         d.drift_from_prev, d.drift_score, d.sentiment_delta, d.topic_jaccard, d.mood_changed, d.tone_changed,
         g.kind AS trigger_kind, g.value AS trigger_value, g.count AS trigger_count, g.concentration AS trigger_concentration,
         CASE WHEN g.kind IS NOT NULL THEN coalesce(a.names, '') END AS trigger_alternatives
  FROM drift d LEFT JOIN topic_names t ON t.day = d.day LEFT JOIN entity_names e ON e.day = d.day
       LEFT JOIN triggers g ON g.day = d.day AND g.place = 1 LEFT JOIN alternatives a ON a.day = d.day)"""


SQL_TIMELINE = f"WITH {_sql_flat(I.SQL_TURNS, I.LEXICON)} SELECT * EXCLUDE (five_topics, five_entities) FROM flat"
SQL_TIMELINE_EVENTS = f"WITH {_sql_flat(I.SQL_UTTERANCES, DEFAULT)} SELECT * EXCLUDE (five_topics, five_entities) FROM flat"
SQL_TIMELINE_GAPS = (f"WITH {_sql_flat(I.sql_utterances('signup'), DEFAULT)} "
                     "SELECT * EXCLUDE (five_topics, five_entities) FROM flat")
SQL_SUMMARY = f"""WITH {_sql_flat(I.SQL_TURNS, I.LEXICON)}
SELECT day, mood, tone, avg_compound, drift_score, drift_from_prev, five_topics AS top_topics,
       five_entities AS top_entities, trigger_value AS trigger FROM flat"""
SQL_DRIFT_TRIGGERS = f"""WITH {_sql_flat(I.SQL_TURNS.replace('* 7 - 1', '* 40 - 1'), I.LEXICON)}
SELECT g.day, g.kind, g.value, g.label, CASE WHEN g.kind = 'topic' THEN g.strength END AS score, g.count,
       g.distinct_convos, g.concentration, coalesce(a.names, '') AS alternatives
FROM triggers g LEFT JOIN alternatives a USING (day) WHERE g.place = 1"""

QUERIES = {
    "turns_strict": (turns_strict, SQL_STRICT),
    "turns_lenient": (turns_lenient, SQL_LENIENT),
    "turn_days": (turn_days, SQL_TURN_DAYS),
    "bin_rows": (bin_rows, SQL_BIN_ROWS),
    "bin_session": (bin_session, SQL_BIN_SESSION),
    "bin_rows_composite": (bin_rows_composite, SQL_BIN_ROWS_COMPOSITE),
    "bin_session_string": (bin_session_string, SQL_BIN_SESSION_STRING),
    "bin_session_first_seen": (bin_session_first_seen, SQL_BIN_SESSION_FIRST_SEEN),
    "bin_timestamp": (bin_timestamp, SQL_BIN_TIMESTAMP),
    "assign_days": (assign_days, SQL_ASSIGN),
    "surface_features": (surface_features, SQL_SURFACE),
    "utterance_features": (utterance_features, SQL_UTTERANCE_FEATURES),
    "clean_text": (clean_text, None),
    "sentiment_turns": (sentiment_turns, SQL_SENTIMENT_TURNS),
    "sentiment_utterances": (sentiment_utterances, SQL_SENTIMENT_UTTERANCES),
    "mood_labels": (mood_labels, SQL_MOOD),
    "daily_rollup": (daily_rollup, SQL_ROLLUP),
    "daily_rollup_events": (daily_rollup_events, SQL_ROLLUP_EVENTS),
    "sentiment_range": (sentiment_range, SQL_RANGE),
    "term_counts": (term_counts, SQL_TERM_COUNTS),
    "topics_top": (topics_top, SQL_TOPICS),
    "topic_concentration": (topic_concentration, SQL_CONCENTRATION),
    "topic_concentration_events": (topic_concentration_events, SQL_CONCENTRATION_EVENTS),
    "entity_mentions": (entity_mentions, SQL_MENTIONS),
    "entities_top": (entities_top, SQL_ENTITIES),
    "entities_merged": (entities_merged, f"""WITH {_SQL_PROFILE_MENTIONS}
        SELECT entity, count(*) AS n, count(DISTINCT conversation_id) AS exact, TRUE AS near FROM mentions GROUP BY entity"""),
    "entities_tagged": (entities_tagged, None),
    "entity_rollup": (entity_rollup, SQL_ENTITY_ROLLUP),
    "candidate_record": (candidate_record, SQL_CANDIDATE_RECORD),
    "entity_rollup_wide": (entity_rollup_wide, SQL_ENTITY_ROLLUP_WIDE),
    "sentiment_documents": (sentiment_documents, SQL_SENTIMENT_DOCUMENTS),
    "drift_timeline_gaps": (drift_timeline_gaps, SQL_TIMELINE_GAPS),
    "contradiction_candidates": (contradiction_candidates, SQL_CANDIDATES),
    "candidate_counts": (candidate_counts, SQL_CANDIDATE_COUNTS),
    "drift_timeline": (drift_timeline, SQL_TIMELINE),
    "drift_timeline_events": (drift_timeline_events, SQL_TIMELINE_EVENTS),
    "timeline_summary": (timeline_summary, SQL_SUMMARY),
    "drift_triggers": (drift_triggers, SQL_DRIFT_TRIGGERS),
}
