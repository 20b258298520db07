"""Labels, samples, metrics and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import inputs as I
from suite import sqlparts as Q
from turnloom import constants as K
from turnloom.functions import rules
from turnloom.operators import evaluation, intent, sampling
from turnloom.plans import intent as plan


def _labelled(spark, sf):
    """Event sentences with their weak label."""
    u = I.utterances(spark, sf).select(F.col("turn_index").alias("event_id"), "text")
    return plan.label_lines(u)


def weak_labels(spark, sf):
    return _labelled(spark, sf).select("event_id", "label", "source_rule")


def weak_labels_corpus(spark, sf):
    """The rules over every line of the dialogues."""
    labelled = plan.label_corpus(I.dialogues(spark, sf))
    return labelled.groupBy("text", "label", "source_rule").agg(F.count("*").alias("n"))


def auto_gold(spark, sf):
    u = I.utterances(spark, sf)
    gold = rules.auto_gold(F.col("text"))
    return u.select(F.col("turn_index").alias("event_id"), gold["label"].alias("label"), gold["reason"].alias("reason"))


def label_distribution(spark, sf):
    return evaluation.label_distribution(_labelled(spark, sf)).select("label", "n", "percent")


def label_distribution_corpus(spark, sf):
    return evaluation.label_distribution(plan.label_corpus(I.dialogues(spark, sf))).select("label", "n", "percent")


def _sample(spark, sf):
    rows = _labelled(spark, sf).withColumn("tie", F.col("event_id").cast("string"))
    return sampling.stratified_head(rows, tie=["tie"])


def dev_sample(spark, sf):
    return _sample(spark, sf).select("event_id", "label", "text", "class_order", "rank")


def gold_table(spark, sf):
    gold = sampling.gold_table(_sample(spark, sf))
    return gold.groupBy(*gold.columns).agg(F.count("*").alias("n"))


def label_agreement(spark, sf):
    return evaluation.agreement(sampling.gold_table(_labelled(spark, sf)))


def message_sample(spark, sf):
    return sampling.sample_messages(I.dialogues(spark, sf), 100)


def message_sample_sparse(spark, sf):
    """The same where two conversations of three hold nothing but a speaker's prefix."""
    cells = I.dialogues(spark, sf)
    raw = F.when(F.col("conversation_id") % 3 == 0, F.col("raw")).otherwise(F.lit("User 1: \n \nUser 2:"))
    return sampling.sample_messages(cells.withColumn("raw", raw), 100)


def _sql_message_sample(raw: str) -> str:
    return f"""WITH {I.SQL_DIALOGUES},
        cells AS (SELECT conversation_id, {raw} AS raw FROM dialogues),
        lines AS (SELECT conversation_id, md5('7|' || CAST(conversation_id AS VARCHAR)) AS key,
                         unnest(string_split(raw, chr(10))) AS line_text,
                         unnest(range(len(string_split(raw, chr(10))))) AS line FROM cells),
        said AS (SELECT conversation_id, key, CAST(line AS INTEGER) AS line,
                        trim(regexp_replace(line_text, '(?i)^\\s*User\\s*[0-9]+\\s*:\\s*', '')) AS text FROM lines)
        SELECT conversation_id, line, text FROM said WHERE text <> '' ORDER BY key, conversation_id, line LIMIT 100"""


def _quality(spark, sf):
    """Stored quality as truth, document length as prediction, both as intent labels."""
    labels = I.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = I.table(spark, sf, "documents").select("doc_id", "n_chars")
    truth = F.when(F.col("quality") == 1, "small-talk").when(F.col("toxic") == 1, "reminder").otherwise("unknown")
    guess = (F.when(F.col("n_chars") > 2000, "small-talk").when(F.col("n_chars") > 500, "unknown")
             .when(F.col("n_chars") > 200, "reminder").otherwise("action-item"))
    return labels.join(docs, "doc_id").select(truth.alias("label"), guess.alias("prediction"))


def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_quality(spark, sf)).select("true_label", "pred_label", "n")


def class_metrics(spark, sf):
    return evaluation.class_metrics(_quality(spark, sf)).select("label", "precision", "recall", "f1", "support")


def macro_f1(spark, sf):
    return evaluation.macro_f1(_quality(spark, sf))


def vocabulary(spark, sf):
    return intent.vocabulary(_labelled(spark, sf)).withColumn("idf", F.round("idf", 6))


def vocabulary_conversations(spark, sf):
    return intent.vocabulary(I.plain_turns(spark, sf)).withColumn("idf", F.round("idf", 6))


def vocabulary_top(spark, sf):
    """A limit on the number of terms that acts."""
    return intent.vocabulary(I.plain_turns(spark, sf), max_features=300).withColumn("idf", F.round("idf", 6))


def labelled_csv(spark, sf):
    """Labelled rows as CSV lines and back."""
    fields = ["event_id", "text", "label", "source_rule"]
    lines = _labelled(spark, sf).select(F.to_csv(F.struct(*fields)).alias("line"))
    return lines.select(F.from_csv("line", "event_id LONG, text STRING, label STRING, source_rule STRING").alias("r")).select("r.*")


def class_weights(spark, sf):
    return intent.balanced_weights(_labelled(spark, sf)).withColumn("weight", F.round("weight", 6))


def train_intent(spark, sf):
    """Metrics record of a model trained on the weak labels."""
    _, record = plan.train_and_evaluate(_labelled(spark, sf))
    return record.select("dev_source", "n_train", "n_dev", "vocab_size", "macro_f1_dev", F.to_json("per_class").alias("per_class"))


def classify_intent(spark, sf):
    """Train on the sentences' weak labels, then classify every conversation turn."""
    model = intent.train(_labelled(spark, sf))
    turns = I.plain_turns(spark, sf).select("conversation_id", "turn_index", "text")
    return intent.classify(turns, model).select("conversation_id", "turn_index", "label", "confidence")


def _any(alternatives: str) -> str:
    return f"regexp_matches(t, '(?i)\\b(?:{alternatives.replace(chr(39), chr(39) * 2)})\\b')"


_FIRST = r"regexp_split_to_array(lower(t), '[\s,.!?]+')[1]"
_IMPERATIVE = f"{_FIRST} IN {Q.in_list(K.IMPERATIVE_VERBS)} AND NOT ends_with(t, '?')"
_SHORT = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) <= 3"


def _case(pairs, fallback) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {fallback} END"


_WEAK = [("t = ''", "unknown", "'empty'"), (_any(K.WEAK_REMINDER), "reminder", "'kw:reminder'"),
         (_IMPERATIVE, "action-item", f"'imperative:' || {_FIRST}"), (_any(K.NEED), "action-item", "'kw:need-to'"),
         (_any(K.WEAK_EMOTION), "emotional-support", "'kw:emotion'"),
         (_any(K.WEAK_SMALL_TALK), "small-talk", "'kw:smalltalk'"), (_SHORT, "small-talk", "'short-utterance'")]
_GOLD = [("t = ''", "unknown", "'empty'"), (_any(K.GOLD_EXPLICIT_REMINDER), "reminder", "'explicit remind-me phrase'"),
         (f"{_any(K.GOLD_REMINDER)} AND {_any(K.GOLD_FUTURE_TIME)}", "reminder", "'reminder kw + future time'"),
         (f"{_any(K.GOLD_STRONG_EMOTION)} AND {_any(K.GOLD_FIRST_PERSON)}", "emotional-support", "'first-person emotion word'"),
         (_any(K.GOLD_CONSOLING), "emotional-support", "'consoling phrase'"),
         (_IMPERATIVE, "action-item", f"'imperative verb ''' || {_FIRST} || ''''"),
         (f"{_any(K.NEED)} AND {_any(K.GOLD_DEADLINE)}", "action-item", "'need-to + deadline'"),
         (_any(K.GOLD_SMALL_TALK), "small-talk", "'greeting/closing keyword'"),
         (_SHORT, "small-talk", "'very short utterance'")]


def _columns(table, fallback, label, reason) -> str:
    return (_case([(c, f"'{lab}'") for c, lab, _ in table], "'unknown'") + f" AS {label}, "
            + _case([(c, r) for c, _, r in table], f"'{fallback}'") + f" AS {reason}")


_WEAK_COLUMNS = _columns(_WEAK, "fallback", "label", "source_rule")
_SQL_LABELLED = f"""{I.SQL_UTTERANCES},
said AS (SELECT turn_index AS event_id, text, trim(text) AS t FROM turns),
labelled AS (SELECT event_id, text, t, {_WEAK_COLUMNS} FROM said)"""
_SQL_LINES = r"""
said AS (SELECT trim(regexp_replace(line, '(?i)^\s*User\s*[0-9]+\s*:\s*', '')) AS t FROM
         (SELECT unnest(string_split(raw, chr(10))) AS line FROM dialogues))"""
_SQL_CORPUS = f"{I.SQL_DIALOGUES}, {_SQL_LINES}, labelled AS (SELECT t AS text, {_WEAK_COLUMNS} FROM said WHERE t <> '')"
_SQL_GOLD = "gold AS (SELECT *, " + _columns(_GOLD, "no rule fired", "gold_label", "reason") + " FROM labelled)"
_LABEL_ROWS = "names(label) AS (VALUES " + ", ".join(f"('{label}')" for label in K.LABELS) + ")"
_DISTRIBUTION = """
SELECT label, count(l.label) AS n,
       round(100.0::DOUBLE * count(l.label) / (SELECT count(*) FROM labelled), 1) AS percent
FROM names LEFT JOIN labelled l USING (label) GROUP BY label"""
_CLASS_ORDER = _case([(f"label = '{label}'", str(i + 1)) for i, label in enumerate(K.LABELS)], "0")
_SQL_SAMPLE = f"""{_SQL_LABELLED},
sample AS (SELECT *, CAST({_CLASS_ORDER} AS INTEGER) AS class_order,
  CAST(row_number() OVER (PARTITION BY label ORDER BY md5('42|' || text || '|' || CAST(event_id AS VARCHAR)), text,
       CAST(event_id AS VARCHAR)) AS INTEGER) AS rank FROM labelled QUALIFY rank <= 30)"""
_SQL_QUALITY = """
pred AS (SELECT CASE WHEN quality = 1 THEN 'small-talk' WHEN toxic = 1 THEN 'reminder' ELSE 'unknown' END AS label,
                CASE WHEN n_chars > 2000 THEN 'small-talk' WHEN n_chars > 500 THEN 'unknown'
                     WHEN n_chars > 200 THEN 'reminder' ELSE 'action-item' END AS prediction
         FROM labels JOIN documents USING (doc_id)),
per AS (
  SELECT n.label, (SELECT count(*) FROM pred p WHERE p.label = n.label AND p.prediction = n.label) AS tp,
         (SELECT count(*) FROM pred p WHERE p.label = n.label) AS n_true,
         (SELECT count(*) FROM pred p WHERE p.prediction = n.label) AS n_pred FROM names n),
rates AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS p,
                 CASE WHEN n_true > 0 THEN tp / n_true ELSE 0 END AS r FROM per),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM rates)"""

# Accents are stripped by DuckDB's own function; it covers the Latin letters of the test tables.
def _sql_vocabulary(rows: str, source: str, limit: int = 10000) -> str:
    return f"""WITH {rows},
docs AS (SELECT row_number() OVER () AS doc, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}') AS l FROM {source}),
grams AS (SELECT doc, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM docs),
counted AS (SELECT term, count(*) AS tf, count(DISTINCT doc) AS df FROM grams GROUP BY term HAVING count(DISTINCT doc) >= 2)
SELECT term, tf, df, round(ln((1 + (SELECT count(*) FROM docs)) / (1 + df)) + 1, 6) AS idf
FROM counted ORDER BY tf DESC, term LIMIT {limit}"""


QUERIES = {
    "weak_labels": (weak_labels, f"WITH {_SQL_LABELLED} SELECT event_id, label, source_rule FROM labelled"),
    "weak_labels_corpus": (weak_labels_corpus, f"""WITH {_SQL_CORPUS}
        SELECT text, label, source_rule, count(*) AS n FROM labelled GROUP BY ALL"""),
    "auto_gold": (auto_gold, f"""WITH {_SQL_LABELLED}, {_SQL_GOLD}
        SELECT event_id, gold_label AS label, reason FROM gold"""),
    "label_distribution": (label_distribution, f"WITH {_SQL_LABELLED}, {_LABEL_ROWS} {_DISTRIBUTION}"),
    "label_distribution_corpus": (label_distribution_corpus, f"WITH {_SQL_CORPUS}, {_LABEL_ROWS} {_DISTRIBUTION}"),
    "dev_sample": (dev_sample, f"WITH {_SQL_SAMPLE} SELECT event_id, label, text, class_order, rank FROM sample"),
    "gold_table": (gold_table, f"""WITH {_SQL_SAMPLE.replace('labelled QUALIFY', 'gold QUALIFY').replace(
        'sample AS', _SQL_GOLD + ', sample AS')}
        SELECT text, gold_label AS label, label AS weak_label, reason AS auto_gold_reason,
               gold_label <> label AS needs_review, count(*) AS n FROM sample GROUP BY ALL"""),
    "label_agreement": (label_agreement, f"""WITH {_SQL_LABELLED}, {_SQL_GOLD}
        SELECT count_if(gold_label = label)::BIGINT AS n_agree, count(*) AS n,
               round(avg(CASE WHEN gold_label = label THEN 1.0::DOUBLE ELSE 0 END), 4) AS rate FROM gold"""),
    "message_sample": (message_sample, _sql_message_sample("raw")),
    "message_sample_sparse": (message_sample_sparse, _sql_message_sample(
        "CASE WHEN conversation_id % 3 = 0 THEN raw ELSE 'User 1: ' || chr(10) || ' ' || chr(10) || 'User 2:' END")),
    "confusion_matrix": (confusion_matrix, f"""WITH {_LABEL_ROWS}, {_SQL_QUALITY}
        SELECT t.label AS true_label, g.label AS pred_label,
               (SELECT count(*) FROM pred p WHERE p.label = t.label AND p.prediction = g.label) AS n
        FROM names t, names g"""),
    "class_metrics": (class_metrics, f"""WITH {_LABEL_ROWS}, {_SQL_QUALITY}
        SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, n_true AS support FROM f"""),
    "macro_f1": (macro_f1, f"""WITH {_LABEL_ROWS}, {_SQL_QUALITY}
        SELECT count(*) AS n_labels, round(avg(f1), 4) AS macro_f1 FROM f WHERE n_true + n_pred > 0"""),
    "vocabulary": (vocabulary, _sql_vocabulary(I.SQL_UTTERANCES, "turns")),
    "vocabulary_conversations": (vocabulary_conversations, _sql_vocabulary("x AS (SELECT 1)", "conversations")),
    "vocabulary_top": (vocabulary_top, _sql_vocabulary("x AS (SELECT 1)", "conversations", 300)),
    "labelled_csv": (labelled_csv, f"WITH {_SQL_LABELLED} SELECT event_id, text, label, source_rule FROM labelled"),
    "class_weights": (class_weights, f"""WITH {_SQL_LABELLED}
        SELECT label, round((SELECT count(*) FROM labelled) / ((SELECT count(DISTINCT label) FROM labelled) * count(*)), 6)
               AS weight, count(*) AS n FROM labelled GROUP BY label"""),
    "train_intent": (train_intent, None),
    "classify_intent": (classify_intent, None),
}
