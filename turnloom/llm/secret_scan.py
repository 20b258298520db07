"""Secret scan over an incremental ledger of blobs. Column expressions and joins only.

A history names versions of files: any key columns and a text. Each text is a blob, addressed by the SHA-256
of its content. The ledger holds one row per blob and rule version already scanned, with its findings; ``scan``
looks only at blobs that lack a row for a rule's present version, and ``findings_by_path`` joins findings
back to every version that has the blob. The same content under many paths is therefore scanned once.

A null text is the empty blob. Keys may be null or repeat; every row of the history keeps its own findings.
An empty history adds nothing to the ledger. Other columns pass through; ones named like an output are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnloom.llm.arrow import drop_column


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``hint`` is a cheap necessary condition on the text. Raise ``version`` whenever anything else changes.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hint: str | None = None
    any_case: bool = False


RULES = [
    Rule("assign", 1, r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         12, group=1, hint="passw secret token apikey api_key", any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 18, hint="AKIA"),
    # A run of hexadecimal digits starts where sixteen follow, so shorter runs need no look.
    Rule("hex", 1, r"[0-9a-f]{16,}", 16),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, hint="-----BEGIN "),
]
LEDGER = "blob STRING, kind STRING, version INT, findings ARRAY<STRUCT<start: INT, end: INT>>"


def blob_id(text: str = "text") -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def _may_match(rule: Rule) -> Column:
    if rule.hint is None:
        return F.col("_text").rlike(rule.pattern)
    where = F.col("_lower") if rule.any_case else F.col("_text")
    out = F.lit(False)
    for word in [rule.hint] if not rule.any_case else rule.hint.split(" "):
        out = out | F.contains(where, F.lit(word))
    return out


def _matches(rule: Rule) -> tuple[Column, Column, Column]:
    """Of each match: the whole, the group that is measured, and the text before it (one more at the end)."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all("_text", pattern, F.lit(0))
    measured = F.regexp_extract_all("_text", pattern, F.lit(rule.group))
    return whole, measured, F.split("_text", rule.pattern)


def scan(history: DataFrame, ledger: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """New ledger rows: one per unseen blob and rule version, also where nothing was found.

    Append them to the ledger. One version of each unseen blob is read, whichever paths share it.
    """
    kinds = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    versions = history.select(blob_id(text).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    blobs = versions.groupBy("blob").agg(F.first("_text").alias("_text"))
    seen = (ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen")))
    todo = (blobs.join(seen, "blob", "left")
            .withColumn("open", F.array_except(kinds, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
            .filter(F.size("open") > 0))
    return _scanned(todo, rules)


def _scanned(todo: DataFrame, rules: list[Rule]) -> DataFrame:
    todo = todo.withColumn("_lower", F.lower("_text"))
    found = []
    for rule in rules:
        whole, measured, gaps = _matches(rule)
        wanted = F.array_contains("open", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")))
        lengths = F.transform(F.arrays_zip(whole.alias("whole"), measured.alias("measured"), gaps.alias("gap")),
                              lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["whole"]).alias("whole"),
                                                 F.length(m["measured"]).alias("measured")))
        found.append(F.when(wanted, F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
            F.when(_may_match(rule), lengths).alias("parts"))))
    rows = (todo.select("blob", F.explode(F.array_compact(F.array(*found))).alias("_r"))
            .select("blob", "_r.*"))
    # The gaps and matches before a match add up to its start; the last gap has no match and drops out.
    span = F.struct((F.col("at") + F.col("gap")).alias("start"),
                    (F.col("at") + F.col("gap") + F.col("whole")).alias("end"))
    before = W.partitionBy("blob", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    some = (rows.filter(F.size("parts") > 1).select("blob", "kind", "version", "least", F.posexplode("parts").alias("i", "p"))
            .select("blob", "kind", "version", "least", "i", "p.*")
            .withColumn("at", F.coalesce(F.sum(F.col("gap") + F.col("whole")).over(before), F.lit(0)).cast("int"))
            .filter(F.col("measured") >= F.col("least"))
            .groupBy("blob", "kind", "version").agg(F.sort_array(F.collect_list(span)).alias("findings")))
    return rows.select("blob", "kind", "version").join(some, ["blob", "kind", "version"], "left").select(
        "blob", "kind", "version",
        F.coalesce("findings", F.array().cast("array<struct<start:int,end:int>>")).alias("findings"))


def findings_by_path(history: DataFrame, ledger: DataFrame, text: str = "text", rules: list[Rule] = RULES,
                     keep_text: bool = True) -> DataFrame:
    """``history`` with its ``blob`` and ``spans``: array of ``start, rank, kind, end`` in that order.

    ``rank`` is the place of the kind in ``rules``. Only the present version of each rule counts; positions
    are code points, the end exclusive.
    """
    for name in ["blob", "spans"]:
        history = drop_column(history, name)
    own = [F.col(f"`{c}`") for c in history.columns if keep_text or c != text]
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))))
    hits = (ledger.filter(F.size("findings") > 0)
            .withColumn("rank", rank[F.concat_ws(":", "kind", F.col("version").cast("string"))])
            .filter(F.col("rank").isNotNull())
            .select("blob", F.explode(F.transform("findings", lambda f: F.struct(
                f["start"].alias("start"), F.col("rank"), F.col("kind"), f["end"].alias("end")))).alias("s"))
            .groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans")))
    versions = history.select(*own, blob_id(text).alias("blob"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return versions.join(hits, "blob", "left").select(*own, "blob", F.coalesce("spans", empty).alias("spans"))
