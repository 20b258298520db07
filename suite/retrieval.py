"""Chunks, vector search, re-rank, contradictions and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import inputs as I
from suite import sqlparts as Q
from turnloom import constants as K
from turnloom.functions import text as T
from turnloom.functions import sentiment
from turnloom.operators import answers, binning, cells, conflicts, dense, pair_model, ranking, vectors
from turnloom.operators import turns as turn_ops
from turnloom.plans import retrieval as plan
from turnloom.scaling import stored
from turnloom.sources import sinks, tables

NEGATIONS = ("in", "de", "der")
NUMBER_WORDS = ("the", "on", "la", "die")


# --- chunks ---------------------------------------------------------------------

def turn_pair_chunks(spark, sf):
    return turn_ops.turn_pair_chunks(I.turns(spark, sf), I.LEXICON)


def dialogue_chunks(spark, sf):
    """Chunks cut inside each dialogue, without a shuffle."""
    return turn_ops.dialogue_chunks(binning.bin_by_rows(I.dialogues(spark, sf), 7), I.LEXICON)


def _with_seeds(spark, sf):
    return plan.build_chunks(turn_ops.turn_pair_chunks(I.turns(spark, sf), I.LEXICON),
                             tables.seed_chunks(spark, lexicon=I.LEXICON))


def chunks_json(spark, sf):
    """Chunks as JSON lines and back, in the stored record's schema."""
    lines = _with_seeds(spark, sf).select(F.to_json(F.struct("*")).alias("line"))
    return lines.select(F.from_json("line", tables.CHUNK_SCHEMA).alias("r")).select("r.*")


def chunks_with_seeds(spark, sf):
    return _with_seeds(spark, sf)


def chunk_counts(spark, sf):
    return turn_ops.chunk_counts(_with_seeds(spark, sf))


# --- vector search over the given embeddings ------------------------------------

def _vectors(spark, sf):
    v = I.table(spark, sf, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"), "embedding", (F.col("vec_id") % 7).cast("int").alias("day_bucket"),
        (((F.col("vec_id") * 37) % 201 - 100) / 100.0).alias("sentiment"), (F.col("label") == 0).alias("synthetic"))


def _centroids(spark, sf):
    """One query per label: the mean of its vectors."""
    v = I.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = v.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])
    return means.groupBy(F.col("label").cast("bigint").alias("qid")).agg(vector.alias("embedding"))


def topk_cosine(spark, sf):
    found = vectors.top_k(_centroids(spark, sf), _vectors(spark, sf))
    return found.withColumn("cosine", F.round("cosine", 4))


def topk_approximate(spark, sf):
    """Every vector whose id is divisible by 50 against all vectors, with the share of the exact hits that are found."""
    pool = _vectors(spark, sf).select("id", "embedding")
    queries = pool.filter("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    index = cells.build(pool)
    found = stored(cells.search(queries, index, K.TOP_K, cells.cells_to_ask(index, pool)), "hits")
    reached = cells.recall(found, vectors.top_k(queries, pool))
    return found.select("qid", "cosine_rank", "id", F.round("cosine", 4).alias("cosine"), F.lit(round(reached, 4)).alias("recall"))


def turn_fingerprints(spark, sf):
    return sinks.fingerprints(I.plain_turns(spark, sf).withColumn("day", F.expr("conversation_id % 7")), "day")


def _ranked(spark, sf, k=K.TOP_K):
    return plan.search(_centroids(spark, sf), _vectors(spark, sf), k)


def composite_rerank(spark, sf):
    return _ranked(spark, sf)


def rank_ablation(spark, sf):
    return ranking.rank_ablation(_ranked(spark, sf)).select(
        "qid", "id", "rank", "cosine_only_rank", "moved")


def ablation_summary(spark, sf):
    return ranking.ablation_summary(_ranked(spark, sf))


def top5_diff(spark, sf):
    changed = ranking.top_changes(_ranked(spark, sf))
    return changed.select("qid", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
                                   for c in ("gained", "dropped")])


def synthetic_positions(spark, sf):
    return ranking.synthetic_positions(_ranked(spark, sf, 30)).select("qid", "id", "rank", "score", "synthetic")


def sentiment_groups(spark, sf):
    groups = ranking.sign_groups(_ranked(spark, sf))
    return groups.select("qid", "sign", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# --- contradictions and answers: all documents, the given vectors dealt out to them in turn ----

def _documents_index(spark, sf):
    """Every document with its own sentiment and the vector whose number is its id modulo their count."""
    v = _vectors(spark, sf)
    docs = I.documents(spark, sf).select(F.col("doc_id").alias("id"), "text").withColumn("vec", F.col("id") % v.count())
    return (docs.join(v.select(F.col("id").alias("vec"), "embedding", "synthetic"), "vec").drop("vec")
            .withColumn("day_bucket", (F.col("id") % 7).cast("int"))
            .withColumn("sentiment", sentiment.compound(F.col("text"), I.LEXICON)))


def _scorer(pairs):
    return conflicts.rule_scores(pairs, NEGATIONS, NUMBER_WORDS)


def _pairs(spark, sf):
    ranked = plan.search(_centroids(spark, sf), _documents_index(spark, sf))
    return conflicts.score_pairs(conflicts.top_pairs(ranked), _scorer)


_PAIR_COLUMNS = ["qid", "a_id", "b_id", "a_rank", "b_rank", "a_day", "b_day", "a_sentiment", "b_sentiment",
                 *conflicts.PROBABILITIES, "verdict", "flagged"]


def contradiction_pairs(spark, sf):
    return _pairs(spark, sf).select(*_PAIR_COLUMNS)


def _unscored_pairs(spark, sf):
    return conflicts.top_pairs(plan.search(_centroids(spark, sf), _documents_index(spark, sf)))


def pair_features(spark, sf):
    made = pair_model.features(_unscored_pairs(spark, sf), NEGATIONS, NUMBER_WORDS)
    return made.select("qid", "a_id", "b_id", *[F.round(name, 6).alias(name) for name in pair_model.FEATURES])


def pair_scores_fitted(spark, sf):
    """The pairs scored by a model fitted on three documents of four, with its calibration error on the fourth."""
    docs = I.documents(spark, sf)
    fourth = F.pmod(F.xxhash64("text"), F.lit(4)) == 2
    model = pair_model.fit(pair_model.weak_pairs(docs.filter(~fourth), I.LEXICON, NEGATIONS, NUMBER_WORDS), NEGATIONS, NUMBER_WORDS)
    held_out = pair_model.weak_pairs(docs.filter(fourth), I.LEXICON, NEGATIONS, NUMBER_WORDS)
    checked = pair_model.calibration(model.score(held_out)).first()
    scored = conflicts.score_pairs(_unscored_pairs(spark, sf), model.score)
    return scored.select("qid", "a_id", "b_id", *conflicts.PROBABILITIES, "verdict",
                         F.lit(checked.accuracy).cast("double").alias("accuracy"), F.lit(checked.error).cast("double").alias("calibration_error"))


def seed_pairs(spark, sf):
    """Every pair of benchmark texts, as seeds of seven days."""
    seeds = I.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), "text", (F.col("item_id") % 7).cast("int").alias("day_bucket"),
        sentiment.compound(F.col("text"), I.LEXICON).alias("sentiment"))
    return conflicts.score_pairs(conflicts.seed_pairs(seeds), _scorer).select(*_PAIR_COLUMNS)


def flagged_pairs(spark, sf):
    return conflicts.flagged_pairs(_pairs(spark, sf)).select(
        "qid", "a_id", "b_id", "contradiction_prob", "a_text", "b_text")


def pair_verdict(spark, sf):
    return _pairs(spark, sf).groupBy("qid", "verdict").agg(F.count("*").alias("n"))


def _questions(spark, sf):
    named = _centroids(spark, sf)
    return named.withColumn("query", F.concat(F.lit("What about my label"), F.col("qid").cast("string"))).withColumn(
        "entity", F.lit("the shore"))


def resolve_vectors(spark, sf):
    """Answers over the given vectors: text, confidence and number of conflicts."""
    found = plan.resolve(_questions(spark, sf), _documents_index(spark, sf), scorer=_scorer)
    return found.select("qid", "query", "entity", "answer", F.size("source_chunks").alias("n_sources"),
                        F.size(F.coalesce("contradictions", F.array())).alias("n_contradictions"), "confidence")


def synthetic_hits(spark, sf):
    return answers.synthetic_hits(plan.resolve(_questions(spark, sf), _documents_index(spark, sf), scorer=_scorer))


def excerpt(spark, sf):
    """The line of each chunk that says most about the entity."""
    chunks = turn_ops.turn_pair_chunks(I.turns(spark, sf), I.LEXICON)
    return chunks.select("id", T.excerpt(F.col("text"), F.lit("the shonand")).alias("excerpt"),
                         T.shorten(F.col("text"), 90, " ⏎ ").alias("short"))


def entity_from_query(spark, sf):
    """Entity of a question built from each turn."""
    asked = F.concat(F.when(F.col("speaker") == 1, "Tell me about my ").when(F.col("speaker") == 2, "Where is my ")
                     .otherwise("What "), F.col("text"))
    return I.plain_turns(spark, sf).select("conversation_id", "turn_index",
                                           T.entity_from_query(asked).alias("entity"))


def resolve_batch(spark, sf):
    """Benchmark passages as questions to the conversation chunks, embedded by hashed TF-IDF."""
    chunks = _with_seeds(spark, sf)
    index, encoder = plan.index_chunks(chunks)
    asked = I.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit(None).cast("string").alias("entity"))
    found = plan.resolve(asked, index, encoder, scorer=_scorer)
    return found.select("qid", "entity", "answer", "confidence",
                        F.array_join(F.col("source_chunks.id"), ",").alias("sources"),
                        F.size(F.coalesce("contradictions", F.array())).alias("n_contradictions"))


def embed_chunks(spark, sf):
    index, _ = plan.index_chunks(_with_seeds(spark, sf))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return index.select("id", F.size("embedding").alias("dimensions"), F.round(norm, 4).alias("norm"))


def embed_chunks_dense(spark, sf):
    """All conversation chunks in the space of the leading 384 singular vectors, and the share of each that it keeps."""
    chunks = _with_seeds(spark, sf)
    projected = dense.fit(chunks).projected(chunks)
    kept = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return projected.select("id", F.size("embedding").alias("dimensions"), F.round(kept, 4).alias("share_kept"))


_SQL_CHUNKS = f"""{I.SQL_TURNS},
chunk_text AS (
  SELECT conversation_id, turn_index // 2 AS pair, CAST(min(turn_index) AS INTEGER) AS turn_index,
         CAST(min(day) AS INTEGER) AS day,
         string_agg('User ' || CAST(speaker AS VARCHAR) || ': ' || text, chr(10) ORDER BY turn_index) AS text
  FROM turns GROUP BY conversation_id, turn_index // 2),
{Q.sentiment(I.LEXICON, 'chunk_text', 'conversation_id, turn_index', 'cs')},
chunks AS (
  SELECT 'c' || CAST(conversation_id AS VARCHAR) || '_t' || CAST(turn_index AS VARCHAR) AS id, text, conversation_id,
         turn_index, day AS day_bucket, compound AS sentiment, FALSE AS synthetic
  FROM chunk_text JOIN cs USING (conversation_id, turn_index))"""
_SEED_ROWS = ", ".join(f"({i}, {day}, {I.quoted(text)})" for i, (day, text) in enumerate(K.SEED_CHUNKS))
_SQL_SEEDED = f"""{_SQL_CHUNKS}, seeds(i, day, text) AS (VALUES {_SEED_ROWS}),
{Q.sentiment(I.LEXICON, 'seeds', 'i', 'ss')},
every_chunk AS (SELECT * FROM chunks UNION ALL
  SELECT 'syn_sister_' || CAST(i AS VARCHAR), text, CAST(-1 AS BIGINT), CAST(0 AS INTEGER), CAST(day AS INTEGER), compound, TRUE
  FROM seeds JOIN ss USING (i))"""
_SQL_DIALOGUE_CHUNKS = f"""{I.SQL_DIALOGUES},
convs AS (SELECT conversation_id, row_number() OVER (ORDER BY conversation_id) AS i, count(*) OVER () AS n FROM dialogues),
lines AS (SELECT conversation_id, unnest(l) AS line, unnest(range(len(l))) AS i
          FROM (SELECT conversation_id, string_split(raw, chr(10)) AS l FROM dialogues)),
kept AS (
  SELECT conversation_id, i, regexp_extract(line, '(?i)^\\s*User\\s*([0-9]+)\\s*:\\s*', 1) AS speaker,
         trim(regexp_replace(line, '(?i)^\\s*User\\s*[0-9]+\\s*:\\s*', '')) AS text
  FROM lines WHERE regexp_matches(line, '(?i)^\\s*User\\s*([0-9]+)\\s*:\\s*')),
spoken AS (SELECT conversation_id, speaker, text,
                  row_number() OVER (PARTITION BY conversation_id ORDER BY i) - 1 AS turn_index FROM kept WHERE text <> ''),
chunk_text AS (
  SELECT conversation_id, CAST(min(turn_index) AS INTEGER) AS turn_index,
         string_agg('User ' || speaker || ': ' || text, chr(10) ORDER BY turn_index) AS text
  FROM spoken GROUP BY conversation_id, turn_index // 2),
{Q.sentiment(I.LEXICON, 'chunk_text', 'conversation_id, turn_index', 'cs')}
SELECT 'c' || CAST(conversation_id AS VARCHAR) || '_t' || CAST(turn_index AS VARCHAR) AS id, text, conversation_id,
       turn_index, CAST((v.i * 7 - 1) // v.n AS INTEGER) AS day_bucket, compound AS sentiment, FALSE AS synthetic
FROM chunk_text JOIN cs USING (conversation_id, turn_index) JOIN convs v USING (conversation_id)"""

_SQL_HITS = """
vecs AS (SELECT vec_id AS id, label, embedding, CAST(vec_id % 7 AS INTEGER) AS day_bucket,
                ((vec_id * 37) % 201 - 100) / 100.0::DOUBLE AS sentiment, label = 0 AS synthetic FROM embeddings),
cells AS (SELECT id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM vecs),
means AS (SELECT label AS qid, pos, avg(x) AS m FROM cells GROUP BY ALL),
qnorm AS (SELECT qid, sqrt(sum(m * m)) AS n FROM means GROUP BY qid),
vnorm AS (SELECT id, sqrt(sum(x * x)) AS n FROM cells GROUP BY id),
dots AS (SELECT qid, id, sum(m * x) AS d FROM means JOIN cells USING (pos) GROUP BY qid, id),
cosines AS (SELECT CAST(qid AS BIGINT) AS qid, id, d / (q.n * v.n) AS cosine
            FROM dots JOIN qnorm q USING (qid) JOIN vnorm v USING (id)),
pool AS ({pool}),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS INTEGER) AS cosine_rank FROM pool
         QUALIFY cosine_rank <= {k})"""
_SQL_RANKED = """{hits},
detailed AS (SELECT h.*, d.day_bucket, d.sentiment, d.synthetic {text} FROM hits h JOIN {details} d USING (id)),
normed AS (SELECT *, (cosine - min(cosine) OVER q) / (max(cosine) OVER q - min(cosine) OVER q) AS nrm,
                  day_bucket / 6.0::DOUBLE AS rec, abs(sentiment) AS emo FROM detailed WINDOW q AS (PARTITION BY qid)),
ranked AS (
  SELECT qid, id, cosine_rank, day_bucket, sentiment, synthetic {text_only}, round(cosine, 4) AS cosine_sim,
         round(nrm, 4) AS cosine_norm, round(rec, 4) AS recency_norm, round(emo, 4) AS emotional_weight,
         round(0.5::DOUBLE * nrm + 0.3::DOUBLE * rec + 0.2::DOUBLE * emo, 4) AS score FROM normed),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cosine_rank) AS INTEGER) AS rank FROM ranked),
ablated AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine_sim DESC, rank) AS INTEGER) AS cosine_only_rank
            FROM placed)"""


def _ranked_sql(k=K.TOP_K, documents=False) -> str:
    dealt = "(SELECT count(*) FROM embeddings)"
    pool = (f"SELECT qid, doc_id AS id, cosine FROM cosines c JOIN documents ON doc_id % {dealt} = c.id" if documents
            else "SELECT * FROM cosines")
    prefix = ""
    if documents:
        prefix = (f"texts AS (SELECT doc_id AS id, text FROM documents), {Q.sentiment(I.LEXICON, 'texts', 'id', 'ds')}, ")
    detailed = ("(SELECT t.id, CAST(t.id % 7 AS INTEGER) AS day_bucket, v.synthetic, s.compound AS sentiment, t.text "
                f"FROM texts t JOIN ds s USING (id) JOIN vecs v ON t.id % {dealt} = v.id)") if documents else "vecs"
    return prefix + _SQL_RANKED.format(
        hits=_SQL_HITS.format(k=k, pool=pool), details=detailed,
        text=", d.text" if documents else "", text_only=", text" if documents else "")


def _neg(side):
    return f"len(list_intersect({side}, [{', '.join(I.quoted(w) for w in NEGATIONS)}])) > 0"


_NUMS = "list_filter({}, lambda w: w IN " + Q.in_list(NUMBER_WORDS) + " OR regexp_full_match(w, '[0-9]+'))"
_SQL_SCORED = f"""
both_sides AS (
  SELECT a.qid, a.id AS a_id, b.id AS b_id, a.rank AS a_rank, b.rank AS b_rank, a.day_bucket AS a_day, b.day_bucket AS b_day,
         a.sentiment AS a_sentiment, b.sentiment AS b_sentiment, a.text AS a_text, b.text AS b_text,
         a.words AS aw, b.words AS bw, {_NUMS.format('a.words')} AS an, {_NUMS.format('b.words')} AS bn
  FROM side a JOIN side b ON a.qid = b.qid AND a.rank < b.rank),
logits AS (
  SELECT *, exp(CASE WHEN ({_neg('aw')}) <> ({_neg('bw')}) THEN 1.5::DOUBLE ELSE 0 END
    + CASE WHEN len(an) > 0 AND len(bn) > 0 AND len(list_intersect(an, bn)) = 0 THEN 2 ELSE 0 END
    + CASE WHEN (a_sentiment > 0.05 AND b_sentiment < -0.05) OR (a_sentiment < -0.05 AND b_sentiment > 0.05)
      THEN 2 ELSE 0 END) AS c,
    exp(4 * CASE WHEN len(aw) + len(bw) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(aw, bw))::DOUBLE
      / len(list_distinct(list_concat(aw, bw))) END) AS e, exp(1.0::DOUBLE) AS n FROM both_sides),
scored_pairs AS (
  SELECT *, round(c / (c + e + n), 4) AS contradiction_prob, round(e / (c + e + n), 4) AS entailment_prob,
         round(n / (c + e + n), 4) AS neutral_prob, c / (c + e + n) > 0.6 AS flagged,
         CASE WHEN c >= e AND c >= n THEN 'contradiction' WHEN e >= n THEN 'entailment' ELSE 'neutral' END AS verdict
  FROM logits)"""
_SQL_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS words"
_SQL_PAIRS = f"""{_ranked_sql(documents=True)},
side AS (SELECT *, {_SQL_WORDS} FROM placed WHERE rank <= 5), {_SQL_SCORED}"""
_SQL_SEED_PAIRS = f"""texts AS (SELECT item_id AS id, text FROM benchmark), {Q.sentiment(I.LEXICON, 'texts', 'id', 'ds')},
side AS (SELECT 0::BIGINT AS qid, t.id, CAST(t.id % 7 AS INTEGER) AS day_bucket, s.compound AS sentiment, t.text,
                row_number() OVER (ORDER BY t.id % 7, t.id) AS rank, {_SQL_WORDS.replace('lower(text)', 'lower(t.text)')}
         FROM texts t JOIN ds s USING (id)), {_SQL_SCORED}"""


def _cut(column, n, newline):
    flat = f"replace({column}, chr(10), '{newline}')"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE substr({flat}, 1, {n - 1}) || '…' END"


def _sql_excerpt(source: str, entity_tokens, phrase: str, out: str) -> str:
    """CTEs ending in ``out(key, excerpt)`` for ``source(key, text)``."""
    hits = " + ".join(f"CASE WHEN contains(lower(body), {I.quoted(t)}) THEN 1 ELSE 0 END" for t in entity_tokens)
    return f"""
{out}_l AS (SELECT key, unnest(l) AS line, unnest(range(len(l))) AS i FROM (
  SELECT key, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {source})),
{out}_b AS (SELECT key, i, line, CASE WHEN regexp_matches(line, '(?i)^User\\s+[0-9]+\\s*:\\s*(.+)$')
  THEN trim(regexp_extract(line, '(?i)^User\\s+[0-9]+\\s*:\\s*(.+)$', 1)) END AS body FROM {out}_l),
{out}_u AS (SELECT *, {hits} + CASE WHEN contains(lower(body), {I.quoted(phrase)}) THEN 1 ELSE 0 END AS hits
            FROM {out}_b WHERE length(body) >= 8),
{out}_best AS (SELECT key, body FROM {out}_u WHERE hits > 0
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY hits DESC, length(body) DESC, body DESC) = 1),
{out}_first AS (SELECT key, body FROM {out}_u QUALIFY row_number() OVER (PARTITION BY key ORDER BY i) = 1),
{out}_all AS (SELECT key, string_agg(line, ' ' ORDER BY i) AS body FROM {out}_l GROUP BY key),
{out}_pick AS (SELECT s.key, coalesce(b.body, f.body, a.body, '') AS body FROM {source} s LEFT JOIN {out}_best b ON b.key = s.key
  LEFT JOIN {out}_first f ON f.key = s.key LEFT JOIN {out}_all a ON a.key = s.key),
{out} AS (SELECT key, CASE WHEN length(body) <= 180 THEN body ELSE substr(body, 1, 179) || '…' END AS excerpt FROM {out}_pick)"""


_SQL_EXCERPT = f"""WITH {_SQL_CHUNKS}, src AS (SELECT id AS key, text FROM chunks),
{_sql_excerpt('src', ['shonand'], 'the shonand', 'ex')}
SELECT key AS id, excerpt, {_cut('text', 90, ' ⏎ ')} AS short FROM ex JOIN src USING (key)"""
_SQL_ENTITY = r"""
WITH asked AS (SELECT conv_id AS conversation_id, CAST(turn AS INTEGER) AS turn_index,
  CASE role WHEN 'user' THEN 'Tell me about my ' WHEN 'assistant' THEN 'Where is my ' ELSE 'What ' END || text AS q FROM conversations)
SELECT conversation_id, turn_index, coalesce(
  nullif(regexp_extract(q, '(?i)about\s+(?:my\s+)?([A-Za-z][A-Za-z''\-]*)', 1), ''),
  nullif(regexp_extract(q, '(?i)(?:^|[^\p{L}\p{N}_])my\s+([A-Za-z][A-Za-z''\-]*)', 1), ''), 'this topic') AS entity FROM asked"""
_SQL_RESOLVE = f"""WITH {_SQL_PAIRS},
key_text AS (SELECT DISTINCT id AS key, text FROM placed WHERE rank <= 5),
{_sql_excerpt('key_text', ['shore'], 'the shore', 'ex')},
top5 AS (SELECT * FROM placed WHERE rank <= 5),
spans AS (SELECT qid, count(*) AS n, min(day_bucket) AS d0, max(day_bucket) AS d1,
  avg(cosine_sim) FILTER (rank <= 3) AS mean_cos, arg_min(id, day_bucket * 100 + rank) AS first_id,
  arg_max(id, day_bucket * 100 + rank) AS last_id, count_if(synthetic)::INTEGER AS n_synthetic FROM top5 GROUP BY qid),
pair AS (SELECT *, CASE WHEN a_day <= b_day THEN a_id ELSE b_id END AS e_id, least(a_day, b_day) AS e_day,
  CASE WHEN a_day <= b_day THEN b_id ELSE a_id END AS l_id, greatest(a_day, b_day) AS l_day FROM scored_pairs WHERE flagged
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY contradiction_prob DESC, a_rank, b_rank) = 1),
conf AS (SELECT qid, count(*) AS n FROM scored_pairs WHERE flagged GROUP BY qid),
parts AS (
  SELECT s.*, coalesce(p.e_id, s.first_id) AS e_id, coalesce(p.e_day, s.d0) AS e_day, coalesce(p.l_id, s.last_id) AS l_id,
    coalesce(p.l_day, s.d1) AS l_day, coalesce(c.n, 0) AS n_conf,
    CASE WHEN p.qid IS NULL THEN 'Note: these accounts read as consistent in tone.'
      WHEN (a_sentiment > 0.05 AND b_sentiment < -0.05) OR (a_sentiment < -0.05 AND b_sentiment > 0.05)
      THEN 'Note: these accounts conflict on emotional tone (one positive, one negative).'
      ELSE 'Note: these accounts appear inconsistent on factual details.' END AS note
  FROM spans s LEFT JOIN pair p USING (qid) LEFT JOIN conf c USING (qid))"""

QUERIES = {
    "turn_pair_chunks": (turn_pair_chunks, f"WITH {_SQL_CHUNKS} SELECT * FROM chunks"),
    "dialogue_chunks": (dialogue_chunks, f"WITH {_SQL_DIALOGUE_CHUNKS}"),
    "chunks_json": (chunks_json, f"WITH {_SQL_SEEDED} SELECT * FROM every_chunk"),
    "chunks_with_seeds": (chunks_with_seeds, f"WITH {_SQL_SEEDED} SELECT * FROM every_chunk"),
    "chunk_counts": (chunk_counts, f"""WITH {_SQL_SEEDED}
        SELECT count_if(NOT synthetic)::BIGINT AS n_natural, count_if(synthetic)::BIGINT AS n_synthetic,
               count(*) AS n_total FROM every_chunk"""),
    "topk_cosine": (topk_cosine, f"""WITH {_SQL_HITS.format(k=15, pool='SELECT * FROM cosines')}
        SELECT qid, cosine_rank, id, round(cosine, 4) AS cosine FROM hits"""),
    "topk_approximate": (topk_approximate, None),
    "turn_fingerprints": (turn_fingerprints, """
        WITH rows AS (
          SELECT conv_id % 7 AS period, conv_id AS a, conv_id % 7 AS b,
                 CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS c, text AS d, turn AS e FROM conversations),
        digests AS (
          SELECT period, md5(concat_ws('|', coalesce(length(a::VARCHAR) || ':' || a, '-'), coalesce(length(b::VARCHAR) || ':' || b, '-'),
                                       coalesce(length(c::VARCHAR) || ':' || c, '-'), coalesce(length(d) || ':' || d, '-'),
                                       coalesce(length(e::VARCHAR) || ':' || e, '-'))) AS h FROM rows)
        SELECT period, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT)::DECIMAL(38,0) AS h1,
               sum(('0x' || substr(h, 16, 15))::BIGINT)::DECIMAL(38,0) AS h2 FROM digests GROUP BY period"""),
    "composite_rerank": (composite_rerank, f"WITH {_ranked_sql()} SELECT * FROM placed"),
    "rank_ablation": (rank_ablation, f"""WITH {_ranked_sql()}
        SELECT qid, id, rank, cosine_only_rank, cosine_only_rank - rank AS moved FROM ablated"""),
    "ablation_summary": (ablation_summary, f"""WITH {_ranked_sql()}
        SELECT qid, count(*) AS n_hits, count_if(cosine_only_rank <> rank)::BIGINT AS n_moved FROM ablated GROUP BY qid"""),
    "top5_diff": (top5_diff, f"""WITH {_ranked_sql()}
        SELECT qid, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rank <= 5 AND cosine_only_rank > 5), '') AS gained,
               coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (rank > 5 AND cosine_only_rank <= 5), '') AS dropped
        FROM ablated GROUP BY qid"""),
    "synthetic_positions": (synthetic_positions, f"""WITH {_ranked_sql(30)}
        SELECT qid, id, rank, score, synthetic FROM placed WHERE synthetic OR rank <= 5"""),
    "sentiment_groups": (sentiment_groups, f"""WITH {_ranked_sql()}
        SELECT qid, CASE WHEN sentiment > 0.05 THEN 'pos' WHEN sentiment < -0.05 THEN 'neg' ELSE 'neutral' END AS sign,
               string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids FROM placed WHERE rank <= 5 GROUP BY ALL"""),
    "contradiction_pairs": (contradiction_pairs, f"WITH {_SQL_PAIRS} SELECT {', '.join(_PAIR_COLUMNS)} FROM scored_pairs"),
    "flagged_pairs": (flagged_pairs, f"""WITH {_SQL_PAIRS}
        SELECT qid, a_id, b_id, contradiction_prob, {_cut('a_text', 200, ' | ')} AS a_text, {_cut('b_text', 200, ' | ')} AS b_text
        FROM scored_pairs WHERE flagged"""),
    "pair_features": (pair_features, f"""WITH {_SQL_PAIRS},
        listed AS (SELECT *, regexp_extract_all(lower(a_text), '[a-z0-9'']+') AS al, regexp_extract_all(lower(b_text), '[a-z0-9'']+') AS bl
                   FROM scored_pairs),
        grams AS (SELECT *, list_distinct(list_transform(range(1, len(al)), lambda i: al[i] || ' ' || al[i + 1])) AS ag,
                         list_distinct(list_transform(range(1, len(bl)), lambda i: bl[i] || ' ' || bl[i + 1])) AS bg,
                         len(list_intersect(aw, bw))::DOUBLE AS same FROM listed)
        SELECT qid, a_id, b_id,
          round(CASE WHEN len(aw) + len(bw) = 0 THEN 1 ELSE same / len(list_distinct(list_concat(aw, bw))) END, 6) AS shared,
          round(CASE WHEN len(aw) = 0 THEN 1 ELSE same / len(aw) END, 6) AS a_covered,
          round(CASE WHEN len(bw) = 0 THEN 1 ELSE same / len(bw) END, 6) AS b_covered,
          round(CASE WHEN len(ag) + len(bg) = 0 THEN 1
            ELSE len(list_intersect(ag, bg))::DOUBLE / len(list_distinct(list_concat(ag, bg))) END, 6) AS neighbours,
          (({_neg('aw')}) <> ({_neg('bw')}))::INTEGER::DOUBLE AS negated,
          (len(an) > 0 AND len(bn) > 0 AND len(list_intersect(an, bn)) = 0)::INTEGER::DOUBLE AS other_numbers,
          ((a_sentiment > 0.05 AND b_sentiment < -0.05) OR (a_sentiment < -0.05 AND b_sentiment > 0.05))::INTEGER::DOUBLE AS opposed,
          round(abs(a_sentiment - b_sentiment), 6) AS sentiment_gap FROM grams"""),
    "pair_scores_fitted": (pair_scores_fitted, None),
    "seed_pairs": (seed_pairs, f"WITH {_SQL_SEED_PAIRS} SELECT {', '.join(_PAIR_COLUMNS)} FROM scored_pairs"),
    "pair_verdict": (pair_verdict, f"WITH {_SQL_PAIRS} SELECT qid, verdict, count(*) AS n FROM scored_pairs GROUP BY ALL"),
    "resolve_vectors": (resolve_vectors, f"""{_SQL_RESOLVE}
        SELECT qid, 'What about my label' || CAST(qid AS VARCHAR) AS query, 'the shore' AS entity,
          'You''ve mentioned the shore across ' || CAST(n AS VARCHAR) || ' occasions over ' ||
          CASE WHEN d0 = d1 THEN 'day-bucket ' || CAST(d0 AS VARCHAR)
               ELSE 'day-buckets ' || CAST(d0 AS VARCHAR) || '–' || CAST(d1 AS VARCHAR) END || '. Earlier (day-bucket ' ||
          CAST(e_day AS VARCHAR) || '): "' || e.excerpt || '". Later (day-bucket ' || CAST(l_day AS VARCHAR) || '): "' ||
          l.excerpt || '". ' || note AS answer, CAST(n AS INTEGER) AS n_sources, CAST(n_conf AS INTEGER) AS n_contradictions,
          round(greatest(least(mean_cos * CASE WHEN n_conf > 0 THEN 0.85::DOUBLE ELSE 1 END, 1.0::DOUBLE), 0.0::DOUBLE), 4) AS confidence
        FROM parts JOIN ex e ON e.key = e_id JOIN ex l ON l.key = l_id"""),
    "synthetic_hits": (synthetic_hits, f"{_SQL_RESOLVE} SELECT qid, n_synthetic FROM spans"),
    "excerpt": (excerpt, _SQL_EXCERPT),
    "entity_from_query": (entity_from_query, _SQL_ENTITY),
    "embed_chunks": (embed_chunks, None),
    "embed_chunks_dense": (embed_chunks_dense, None),
    "resolve_batch": (resolve_batch, None),
}
