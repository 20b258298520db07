"""The registered queries of this package over the given tables, with production parameters."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import (
    bpe, centroid_clustering, decontamination, grams, html_extraction, language_id, line_dedup, near_dedup, quality_classifier,
    quality_rules, secret_scan, token_counts, warc, whitening)
from turnloom.llm.storage import shared_path

BPE_FILE = os.environ.get("TURNLOOM_BPE_FILE", public_tokenizers.path("word_bpe_49k.json"))

PIECES_FILE = os.environ.get("TURNLOOM_PIECES_FILE", public_tokenizers.path("piece_bpe_32k.model"))

LABELS = 4096  # labelled rows that the quality classifier learns from, at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame, path: str = BPE_FILE) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    encoded = bpe.encode(docs.select("doc_id", "text"), path, keep_text=False)
    decoded = bpe.decode(encoded, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~grams.held_out()).dropna()
    labels = grams.sample(labels, None, LABELS, "doc_id")
    model = quality_classifier.fit(docs.join(labels, "doc_id"), size=LABELS)
    return quality_classifier.score(docs.withColumn("held_out", grams.held_out()), model, keep_text=False).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~grams.held_out()))
    found = language_id.identify(docs.select("doc_id", grams.held_out().alias("held_out"), "text"), model, keep_text=False)
    return found.select("doc_id", "held_out", F.col("lang_nearest").alias("lang_pred"), "score", "similarity", "rejected")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, out="text").select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeats AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id <> r.last, false) AS gone
  FROM keyed k LEFT JOIN repeats r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secret_scan.scan(docs, secret_scan.empty_ledger(spark))
    found = secret_scan.findings_by_path(docs, ledger, keep_text=False)
    base = ("assign", "access", "hex")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontamination.flag(docs, benchmark, keep_text=False).select(
        "doc_id", "contaminated", "n_items", "covered", F.col("item").alias("item_id"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECES_FILE, keep_text=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = shared_path(spark, "warc")
    warc.write(pages, folder)
    kind = dict(pages.dtypes)["page_id"]
    return warc.read(spark, folder, payload=False).select(
        F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind),
        "problem")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SECRET_RULES = [
    ("assign", _either_case("(?:password|passwd|secret|token|api_?key)")
     + r'''["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''', 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)]


def _sql_matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    found = f"regexp_extract_all(text, '{pattern}', 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, unnest(range(len({found}))) AS i,
               unnest({found}) AS whole, unnest(regexp_extract_all(text, '{pattern}', {group})) AS measured,
               unnest(list_slice(string_split_regex(text, '{pattern}'), 1, len({found}))) AS gap FROM texts"""


SQL_SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_sql_matches(i, *rule) for i, rule in enumerate(_SECRET_RULES))}),
placed AS (SELECT *, coalesce(sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS start FROM matches),
spans AS (SELECT doc_id, kind, rank, CAST(start AS BIGINT) AS start,
                 kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(whole) AS BIGINT) AS span
          FROM placed WHERE length(measured) >= least)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts t LEFT JOIN spans s USING (doc_id) GROUP BY t.doc_id
"""

# Five hexadecimal digits of the SHA-1 make four base-32 letters.
SQL_WARC = """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS smallest FROM hashed GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(h, CAST(j // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS INTEGER) + 1,
         1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = smallest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> smallest THEN smallest END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM hashed JOIN first USING (h)
"""

def _sql_round(last: str, this: str) -> str:
    return f"""{this}_near AS (
  SELECT id, row, arg_min(c, (distance, c)) AS c FROM (
    SELECT x.id, x.row, m.c, sum((x.v - m.v) * (x.v - m.v)) AS distance FROM entries x JOIN {last} m USING (j) GROUP BY ALL)
  GROUP BY ALL),
{this}_mean AS (
  SELECT n.c, x.j, sum(x.v) AS s, count(*) AS k FROM entries x JOIN {this}_near n USING (row) GROUP BY ALL),
{this} AS (
  SELECT l.c, l.j, CASE WHEN k IS NULL THEN l.v ELSE (s - ((s % k) + k) % k) // k END AS v
  FROM {last} l LEFT JOIN {this}_mean USING (c, j))"""


SQL_CLUSTERING = f"""
WITH kept AS (
  SELECT vec_id AS id, row_number() OVER () AS row, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = 64),
entries AS (
  SELECT id, row, unnest(range(64)) AS j, CAST(floor(64 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS v FROM kept),
first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS c FROM kept ORDER BY c LIMIT 16),
m0 AS (SELECT c, j, CAST(v AS HUGEINT) AS v FROM entries JOIN first USING (row)),
{_sql_round("m0", "m1")},
{_sql_round("m1", "m2")},
{_sql_round("m2", "m3")},
found AS (
  SELECT id, row, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT x.id, x.row, m.c, sum((x.v - m.v) * (x.v - m.v)) AS distance FROM entries x JOIN m3 m USING (j) GROUP BY ALL)
  GROUP BY ALL),
digests AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS h FROM m3 GROUP BY c)
SELECT id AS vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       h AS centroid_sha256
FROM found JOIN digests USING (c)
"""

QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_quality_classifier": (op2_quality_classifier, None),
    "op3_language_id": (op3_language_id, None),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_near_dedup": (op5_near_dedup, None),
    "op6_line_dedup": (op6_line_dedup, SQL_LINE_DEDUP),
    "op7_secret_scan": (op7_secret_scan, SQL_SECRET_SCAN),
    "op8_decontamination": (op8_decontamination, None),
    "op9_warc": (op9_warc, SQL_WARC),
    "op10_token_counts": (op10_token_counts, None),
    "op11_centroid_clustering": (op11_centroid_clustering, SQL_CLUSTERING),
    "op12_html_extraction": (op12_html_extraction, None),
    "op13_embedding_whitening": (op13_embedding_whitening, None),
}
