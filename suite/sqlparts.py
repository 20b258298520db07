"""SQL building blocks for the DuckDB twins, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from suite.inputs import quoted
from turnloom import constants as K
from turnloom.functions.sentiment import Lexicon

_PUNCT = r"[!-/:-@\[-`{-~]+"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join(rows) + ")"


def sentiment(lexicon: Lexicon, source: str, keys: str, out: str = "scored") -> str:
    """CTEs ending in ``out(keys…, compound)`` for the rows of ``source(keys…, text)``."""
    lex = values(f"{out}_lex", "word, v", [f"({quoted(w)}, CAST({v} AS DOUBLE))" for w, v in lexicon.valences.items()])
    boost = values(f"{out}_boost", "word, b", [f"({quoted(w)}, CAST({b} AS DOUBLE))" for w, b in lexicon.boosters.items()])
    lags = ", ".join(
        f"lag(v, {d}) OVER w AS v{d}, lag(neg, {d}) OVER w AS neg{d}, lag(b, {d}) OVER w AS b{d}, "
        f"lag(caps, {d}) OVER w AS caps{d}" for d in (1, 2, 3))
    steps, previous = "", f"{out}_s0"
    for d, damping in zip((1, 2, 3), K.BOOST_DAMPING):
        steps += f""",
{out}_s{d} AS (SELECT * REPLACE ((x + CASE WHEN v{d} = 0 AND b{d} <> 0 THEN sign(x) * (b{d} +
    CASE WHEN caps{d} AND shouting THEN {K.CAPS_INCREMENT} ELSE 0 END) * {damping} ELSE 0 END)
    * CASE WHEN v{d} = 0 AND neg{d} THEN {K.NEGATION_FACTOR} ELSE 1 END AS x) FROM {previous})"""
        previous = f"{out}_s{d}"
    return f"""
{lex}, {boost},
{out}_raw AS (
  SELECT {keys}, unnest(toks) AS raw, unnest(range(1, len(toks) + 1)) AS idx FROM (
    SELECT {keys}, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS toks FROM {source})),
{out}_bare AS (SELECT *, regexp_replace(raw, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS bare FROM {out}_raw),
{out}_tok AS (SELECT {keys}, idx, CASE WHEN length(bare) <= 2 THEN raw ELSE bare END AS token FROM {out}_bare),
{out}_desc AS (
  SELECT t.*, lower(token) AS word, token = upper(token) AND token <> lower(token) AS caps,
         coalesce(l.v, 0) AS v, coalesce(o.b, 0) AS b, lower(token) IN {in_list(lexicon.negations)} AS neg
  FROM {out}_tok t LEFT JOIN {out}_lex l ON l.word = lower(token) LEFT JOIN {out}_boost o ON o.word = lower(token)),
{out}_ctx AS (
  SELECT *, {lags}, count_if(caps) OVER p AS n_caps, count(*) OVER p AS n_tok,
         min(CASE WHEN word = {quoted(lexicon.contrast)} THEN idx END) OVER p AS contrast
  FROM {out}_desc WINDOW w AS (PARTITION BY {keys} ORDER BY idx), p AS (PARTITION BY {keys})),
{out}_s0 AS (SELECT *, n_caps > 0 AND n_caps < n_tok AS shouting,
         v + CASE WHEN caps AND n_caps > 0 AND n_caps < n_tok THEN sign(v) * {K.CAPS_INCREMENT} ELSE 0 END AS x
  FROM {out}_ctx WHERE v <> 0){steps},
{out}_sum AS (SELECT {keys}, sum(x * CASE WHEN contrast IS NULL OR idx = contrast THEN 1
    WHEN idx < contrast THEN {K.CONTRAST_BEFORE} ELSE {K.CONTRAST_AFTER} END) AS s FROM {previous} GROUP BY {keys}),
{out}_marks AS (
  SELECT {keys}, least(length(text) - length(replace(text, '!', '')), {K.EXCLAIM_MAX}) * {K.EXCLAIM_INCREMENT} AS ex,
         length(text) - length(replace(text, '?', '')) AS q FROM {source}),
{out}_amp AS (
  SELECT {keys}, s + sign(s) * (ex + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * {K.QUESTION_INCREMENT}
         ELSE {K.QUESTION_CAP} END) AS s FROM (SELECT {keys}, coalesce(s, 0) AS s, ex, q
         FROM {out}_marks LEFT JOIN {out}_sum USING ({keys}))),
{out} AS (SELECT {keys}, round(s / sqrt(s * s + {K.NORMALISATION_ALPHA}), 4) AS compound FROM {out}_amp)
"""


def style_columns(text: str = "text") -> str:
    words = f"regexp_extract_all({text}, '[A-Za-z'']+')"
    contractions = K.CONTRACTIONS.replace("'", "''")
    return f"""
CAST(length({text}) AS INTEGER) AS n_chars, CAST(len({words}) AS INTEGER) AS n_words,
CAST(length({text}) - length(replace({text}, '?', '')) AS INTEGER) AS n_question,
CAST(length({text}) - length(replace({text}, '!', '')) AS INTEGER) AS n_exclaim,
CAST(len(list_filter({words}, lambda w: length(w) >= 2 AND w = upper(w) AND w <> lower(w))) AS INTEGER) AS n_caps,
CAST(coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0) AS INTEGER) AS n_word_chars,
CAST(len(regexp_extract_all({text}, '(?i)\\b(?:{contractions})\\b')) AS INTEGER) AS n_contractions"""


ROLLUP_RATES = """
round(sum(n_question) / greatest(sum(n_words), 1), 5) AS question_rate,
round(sum(n_exclaim) / greatest(sum(n_words), 1), 5) AS exclamation_rate,
round(sum(n_caps) / greatest(sum(n_words), 1), 5) AS caps_ratio,
round(sum(n_word_chars) / greatest(sum(n_words), 1), 4) AS avg_word_len,
round(sum(n_contractions) / greatest(sum(n_words), 1), 5) AS contraction_rate"""


def rollup(turns: str, lexicon: Lexicon) -> str:
    """CTEs ending in ``rollup`` for a ``turns`` CTE."""
    return f"""{turns}, {sentiment(lexicon, 'turns', 'conversation_id, turn_index')},
styled AS (SELECT day, conversation_id, compound, {style_columns()}
           FROM turns JOIN scored USING (conversation_id, turn_index)),
sums AS (SELECT day, count(*) AS n_turns, count(DISTINCT conversation_id) AS n_conversations,
                avg(compound) AS mean_compound, {ROLLUP_RATES} FROM styled GROUP BY day),
rollup AS (
  SELECT day, n_turns, n_conversations, round(mean_compound, 4) AS avg_compound,
         question_rate, exclamation_rate, caps_ratio, avg_word_len, contraction_rate,
         CASE WHEN mean_compound >= 0.5 AND (exclamation_rate >= 0.05 OR caps_ratio >= 0.03) THEN 'playful'
              WHEN mean_compound >= 0.4 THEN 'happy'
              WHEN mean_compound <= -0.4 AND (exclamation_rate >= 0.05 OR caps_ratio >= 0.03) THEN 'frustrated'
              WHEN mean_compound <= -0.2 THEN 'sad'
              WHEN abs(mean_compound) < 0.25 AND question_rate >= 0.06 THEN 'curious' ELSE 'neutral' END AS mood,
         CASE WHEN exclamation_rate >= 0.08 OR caps_ratio >= 0.05 THEN 'playful'
              WHEN avg_word_len - contraction_rate * 4 >= 4.5 AND exclamation_rate < 0.03 THEN 'formal'
              ELSE 'casual' END AS tone
  FROM sums)"""


# Runs of word characters that are not plain letters become a digit, so that ASCII word borders in
# DuckDB fall where Unicode ones do.
PLAIN_WORDS = r"""list_aggregate(list_transform(
  regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+'),
  lambda w: CASE WHEN regexp_full_match(w, '[\p{L}\p{M}\p{N}_]+') AND NOT regexp_full_match(w, '[a-z]+')
            THEN '0' ELSE w END), 'string_agg', '')"""


def topics(stop_words, k: int = K.TOP_TOPICS) -> str:
    """CTEs ending in ``topics(day, rank, term, score, count, distinct_convos)`` for ``turns``."""
    return f"""
plain AS (SELECT day, conversation_id, turn_index, coalesce({PLAIN_WORDS}, '') AS txt FROM turns),
toks AS (SELECT day, conversation_id, turn_index, unnest(l) AS tok, unnest(range(len(l))) AS idx FROM (
  SELECT *, list_filter(regexp_extract_all(txt, '\\b[a-zA-Z][a-zA-Z'']+\\b'),
                        lambda t: t NOT IN {in_list(stop_words)}) AS l FROM plain)),
seq AS (SELECT day, tok, lead(tok) OVER (PARTITION BY day ORDER BY conversation_id, turn_index, idx) AS nxt FROM toks),
terms AS (SELECT day, tok AS term FROM seq UNION ALL SELECT day, tok || ' ' || nxt FROM seq WHERE nxt IS NOT NULL),
tf AS (SELECT day, term, count(*) AS tf FROM terms GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
weights AS (SELECT day, term, tf * (ln((1 + (SELECT count(DISTINCT day) FROM turns)) / (1 + df)) + 1) AS w
            FROM tf JOIN dfs USING (term)),
norms AS (SELECT day, sqrt(sum(w * w)) AS norm FROM weights GROUP BY day),
best AS (SELECT day, term, round(w / norm, 4) AS score,
                row_number() OVER (PARTITION BY day ORDER BY w DESC, term DESC) AS rank
         FROM weights JOIN norms USING (day)),
top_terms AS (SELECT * FROM best WHERE rank <= {k}),
term_hits AS (
  SELECT day, term, sum(h) AS count, count(DISTINCT conversation_id) AS distinct_convos FROM (
    SELECT day, term, conversation_id, len(regexp_extract_all(txt, '\\b' || term || '\\b')) AS h
    FROM plain JOIN top_terms USING (day)) WHERE h > 0 GROUP BY ALL),
topics AS (
  SELECT t.day, CAST(t.rank AS INTEGER) AS rank, t.term, t.score, CAST(coalesce(h.count, 0) AS BIGINT) AS count,
         coalesce(h.distinct_convos, 0) AS distinct_convos
  FROM top_terms t LEFT JOIN term_hits h USING (day, term))"""


MENTIONS = r"""
caps_words AS (SELECT day, conversation_id, turn_index, unnest(l) AS entity, unnest(range(len(l))) AS idx FROM (
  SELECT *, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_''-]+') AS l FROM turns)),
all_mentions AS (SELECT c.*, g.label FROM caps_words c JOIN gazetteer g ON g.surface = c.entity)"""


def kept_mentions(labels, pronouns) -> str:
    return (f"mentions AS (SELECT * FROM all_mentions WHERE label IN {in_list(labels)} AND length(entity) >= 2 "
            f"AND lower(entity) NOT IN {in_list(pronouns)})")


TOP_ENTITIES = f"""
seen AS (SELECT *, row_number() OVER (ORDER BY conversation_id, turn_index, idx) AS pos FROM mentions),
ent AS (SELECT day, entity AS text, arg_max(label, pos) AS label, count(*) AS count,
               count(DISTINCT conversation_id) AS distinct_convos, min(pos) AS first_pos FROM seen GROUP BY day, entity),
entities AS (SELECT day, CAST(rank AS INTEGER) AS rank, text, label, count, distinct_convos FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY count DESC, first_pos) AS rank FROM ent)
  WHERE rank <= {K.TOP_ENTITIES})"""

DRIFT = f"""
sets AS (SELECT r.*, coalesce(t.terms, []) AS terms FROM rollup r LEFT JOIN
  (SELECT day, list(term) AS terms FROM topics GROUP BY day) t USING (day)),
lagged AS (SELECT *, lag(avg_compound) OVER w AS p_c, lag(terms) OVER w AS p_terms, lag(mood) OVER w AS p_mood,
                  lag(tone) OVER w AS p_tone FROM sets WINDOW w AS (ORDER BY day)),
deltas AS (
  SELECT *, CASE WHEN p_mood IS NULL THEN 0.0::DOUBLE ELSE abs(avg_compound - p_c) END AS sd,
         CASE WHEN p_mood IS NULL OR len(terms) + len(p_terms) = 0 THEN 1.0::DOUBLE
              ELSE len(list_intersect(terms, p_terms))::DOUBLE
                   / len(list_distinct(list_concat(terms, p_terms))) END AS tj,
         coalesce(p_mood <> mood, FALSE) AS mood_changed, coalesce(p_tone <> tone, FALSE) AS tone_changed
  FROM lagged),
drift AS (
  SELECT *, round(sd, 4) AS sentiment_delta, round(tj, 4) AS topic_jaccard,
         round(least(sd / 0.5, 1.0) * 0.45::DOUBLE + (1.0 - tj) * 0.35::DOUBLE
               + CASE WHEN mood_changed THEN 0.1::DOUBLE ELSE 0 END
               + CASE WHEN tone_changed THEN 0.1::DOUBLE ELSE 0 END, 4) AS drift_score,
         sd > {K.SENTIMENT_DELTA_MIN} OR tj < {K.TOPIC_JACCARD_MAX} OR mood_changed OR tone_changed AS drift_from_prev
  FROM deltas)"""

TRIGGERS = f"""
items AS (
  SELECT day, 'entity' AS kind, rank, text AS value, label, count AS strength, count, distinct_convos FROM entities
  UNION ALL SELECT day, 'topic', rank, term, NULL, score, count, distinct_convos FROM topics),
fresh AS (
  SELECT i.* FROM items i JOIN drift d ON d.day = i.day AND d.drift_from_prev
  WHERE NOT EXISTS (SELECT 1 FROM items e WHERE e.kind = i.kind AND e.value = i.value AND e.day < i.day)
    AND count > 0 AND distinct_convos > 0 AND distinct_convos < {K.TRIGGER_CONVOS_MAX}
    AND 1.0::DOUBLE - distinct_convos::DOUBLE / count > {K.CONCENTRATION_MIN}),
placed AS (SELECT *, round(1.0::DOUBLE - distinct_convos::DOUBLE / count, 4) AS concentration,
                  row_number() OVER (PARTITION BY day, kind ORDER BY strength DESC, rank) AS place FROM fresh),
triggers AS (
  SELECT * FROM placed p WHERE place <= 3 AND kind = (SELECT min(kind) FROM placed q WHERE q.day = p.day))"""
