"""The given tables as turns, dialogues, utterances and chunks, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.sentiment import Lexicon
from turnloom.operators import binning
from turnloom.scaling import local_table, spread

# The text is invented, so word lists are over words that do occur in it.
LEXICON = Lexicon(
    valences={"the": 0.4, "is": 1.2, "that": 0.9, "was": -1.4, "with": 1.9, "for": -0.6, "der": -1.1,
              "ci": -1.8, "la": 1.5, "und": 0.7, "que": -0.8, "this": -2.1, "are": 2.3},
    boosters={"to": 0.293, "en": 0.293, "of": -0.293, "de": -0.293},
    negations=("in", "an", "er"),
    contrast="and",
)
# Thousands of words by a rule: every two syllables of the invented language, valences in turn.
_SYLLABLES = ("an ar at be ble bo ch ci con de der die ea ed eine en er es eux for ga ge ha he ie in ing ion is it keit la le "
              "li lich lo ly ment mi nd nt on or ou pa que ra re rr sch sh st ta th ti tion to tre ue un ung ver wh zu").split()
LARGE_LEXICON = Lexicon(
    valences={a + b: ((7 * i + 3 * j) % 41 - 20) / 10 for i, a in enumerate(_SYLLABLES) for j, b in enumerate(_SYLLABLES)
              if (7 * i + 3 * j) % 41 != 20},
    boosters=dict(LEXICON.boosters), negations=LEXICON.negations, contrast=LEXICON.contrast)
GAZETTEER = [
    ("The", "ORG"), ("Of", "PERSON"), ("And", "GPE"), ("Ci", "GPE"), ("In", "EVENT"), ("To", "PERSON"),
    ("Is", "ORG"), ("Der", "PERSON"), ("De", "GPE"), ("La", "ORG"), ("En", "PERSON"), ("It", "PERSON"),
    ("Die", "DATE"), ("Shen", "PERSON"), ("Erer", "PERSON"), ("Thon", "GPE"), ("Tion", "ORG"),
    ("Orre", "PERSON"), ("Los", "GPE"), ("Thou", "ORG"), ("Enst", "GPE"), ("Inat", "PERSON"),
]
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "en", "de", "la", "it", "that", "for", "on", "as")

# One sentence per kind and size of event: (event_type, smallest value, before the id, after it).
SENTENCES = [
    ("signup", 20.0, "Hello there! I am REALLY happy, thanks user ", "!"),
    ("signup", None, "ok user ", ""),
    ("view", 20.0, "What do you like about page ", "? Is it good?"),
    ("view", None, "We looked at page ", " and it was fine, but not very interesting"),
    ("click", 20.0, "Send the invoice ", " to me"),
    ("click", None, "I have to call user ", " by tomorrow"),
    ("purchase", 20.0, "Don't forget to pay order ", " next week"),
    ("purchase", None, "Please schedule order ", " at 5 pm, it's the best one"),
    ("error", 20.0, "I feel so sad and stressed, order ", " was TERRIBLE!!"),
    ("error", None, "Sorry to hear that, user ", ". That is a problem, isn't it??"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _speaker(role):
    return F.when(role == "user", 1).when(role == "assistant", 2).otherwise(3)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def plain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").cast("int").alias("turn_index"),
        _speaker(F.col("role")).alias("speaker"), "text")


def turns(spark: SparkSession, sf_dir: str, n_bins: int = 7) -> DataFrame:
    """Turns of ``conversations`` in periods of consecutive conversations."""
    return spread(binning.bin_by_session(plain_turns(spark, sf_dir), n_bins, "conversation_id"))


SQL_TURNS = """
convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS i, count(*) OVER () AS n
          FROM (SELECT DISTINCT conv_id FROM conversations)),
turns AS (
  SELECT c.conv_id AS conversation_id, CAST(c.turn AS INTEGER) AS turn_index,
         CASE c.role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS speaker,
         c.text, CAST((v.i * 7 - 1) // v.n AS INTEGER) AS day
  FROM conversations c JOIN convs v USING (conv_id))
"""


def utterances(spark: SparkSession, sf_dir: str, untimed: str | None = None) -> DataFrame:
    """One English sentence per event; a user's events are a conversation, time makes the period.

    Events of the type ``untimed`` have no time.
    """
    columns = ["event_id", "user_id", "ts", "event_type", "value"]
    e = table(spark, sf_dir, "events").select(*columns)
    if untimed is not None:
        e = e.withColumn("ts", F.when(F.col("event_type") != untimed, F.col("ts")))
    e = spread(binning.bin_by_timestamp(e, 7, "ts"))
    text = F.lit("")
    case = None
    for kind, smallest, before, after in SENTENCES:
        condition = F.col("event_type") == kind
        if smallest is not None:
            condition = condition & (F.col("value") >= smallest)
        sentence = F.concat(F.lit(before), F.col("user_id").cast("string"), F.lit(after))
        case = F.when(condition, sentence) if case is None else case.when(condition, sentence)
    return e.select(F.col("user_id").alias("conversation_id"), F.col("event_id").alias("turn_index"), "ts", "day",
                    case.otherwise(text).alias("text"))


def _sql_sentence() -> str:
    whens = []
    for kind, smallest, before, after in SENTENCES:
        size = "" if smallest is None else f" AND value >= {smallest}"
        whens.append(f"WHEN event_type = {quoted(kind)}{size} THEN "
                     f"{quoted(before)} || CAST(user_id AS VARCHAR) || {quoted(after)}")
    return "CASE " + " ".join(whens) + " ELSE '' END"


def sql_utterances(untimed: str | None = None) -> str:
    """The events as turns; those without a time are in no period."""
    kept = "" if untimed is None else f" WHERE event_type <> {quoted(untimed)}"
    return f"""
stamped AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi
            FROM events{kept}),
turns AS (
  SELECT user_id AS conversation_id, event_id AS turn_index, {_sql_sentence()} AS text,
         CAST(greatest(CAST(ceil(CAST((us - lo) * 7 AS DOUBLE) / (hi - lo)) AS BIGINT) - 1, 0) AS INTEGER) AS day
  FROM stamped)
"""


SQL_UTTERANCES = sql_utterances()


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversation_id, raw``: every text of ``conversations`` as one multi-line dialogue cell.

    Users' lines all carry a speaker prefix, an assistant's only the first, the system's none.
    """
    c = table(spark, sf_dir, "conversations")
    prefixed = F.concat(F.lit("User 1: "), F.replace("text", F.lit("\n"), F.lit("\nuser 2 :")))
    raw = (F.when(F.col("role") == "user", prefixed)
           .when(F.col("role") == "assistant", F.concat(F.lit("User 2: "), F.col("text"))).otherwise(F.col("text")))
    return spread(c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("conversation_id"), raw.alias("raw")))


SQL_DIALOGUES = """
dialogues AS (
  SELECT conv_id * 100000 + turn AS conversation_id,
         CASE role WHEN 'user' THEN 'User 1: ' || replace(text, chr(10), chr(10) || 'user 2 :')
                   WHEN 'assistant' THEN 'User 2: ' || text ELSE text END AS raw
  FROM conversations)
"""


def gazetteer(spark: SparkSession) -> DataFrame:
    return local_table(spark, GAZETTEER, "surface STRING, label STRING")


SQL_GAZETTEER = ("gazetteer(surface, label) AS (VALUES "
                 + ", ".join(f"({quoted(s)}, {quoted(label)})" for s, label in GAZETTEER) + ")")
