"""Text expressions: columns in, columns out, nothing but built-in functions on the hot path."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import constants as K


def strip(text: Column) -> Column:
    """Remove whitespace of every kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def words_regex(alternatives: str) -> str:
    """Case-insensitive whole-word pattern with Unicode word borders on every JDK."""
    return rf"(?iU)\b(?:{alternatives})\b"


def _normalizer(form: str, drop_marks: bool):
    def one(text: str) -> str:
        text = unicodedata.normalize(form, text)
        return "".join(c for c in text if not unicodedata.combining(c)) if drop_marks else text

    def normalize(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):  # nothing to do, as in any batch of ASCII texts
            return texts
        return pa.array([None if text is None else one(text) for text in texts.to_pylist()], texts.type)

    return F.arrow_udf(normalize, "string")


def unicode_normalize(text: Column, form: str = "NFKC", drop_marks: bool = False) -> Column:
    """Unicode normal form. ASCII text is its own normal form and never leaves the JVM."""
    needs = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_normalizer(form, drop_marks)(needs), text)


def clean_preserve_case(text: Column) -> Column:
    """Normal form, plain dashes and quotes, squeezed repeats and whitespace; null gives ''."""
    t = unicode_normalize(F.coalesce(text, F.lit("")))
    for pattern, plain in (
        ("[‐-―−]", "-"),
        ("[‘’‚‛]", "'"),
        ("[“”„‟]", '"'),
        (r"([!?.,])\1{2,}", "$1"),
        (r"([^\n])\1{3,}", "$1$1"),
        (r"(?U)[\s\x1c-\x1f]+", " "),
    ):
        t = F.regexp_replace(t, pattern, plain)
    return F.trim(t)


def clean(text: Column) -> Column:
    return F.lower(clean_preserve_case(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))


def first_token(text: Column) -> Column:
    """Lower-cased text before the first delimiter; '' when it starts with one."""
    return F.split(F.lower(text), r"(?U)[\s,.!?]+", 2)[0]


def shorten(text: Column, n: int, newline: str | None = None) -> Column:
    """Cut to ``n`` characters ending in an ellipsis, newlines shown as ``newline``."""
    if newline is not None:
        text = F.replace(text, F.lit("\n"), F.lit(newline))
    return F.when(F.length(text) <= n, text).otherwise(
        F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def pairs_of(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space."""
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.filter(F.zip_with(tokens, following, lambda a, b: F.concat(a, F.lit(" "), b)),
                    lambda pair: pair.isNotNull())


def topic_tokens(text: Column, stop_words: list[str]) -> Column:
    """Lower-cased alphabetic tokens of two letters or more without stop words."""
    # The cheap letter test comes first; the Unicode word borders are looked at only after it.
    pattern = r"[a-zA-Z](?<!(?U:\w).)[a-zA-Z']+(?U:\b)"
    tokens = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def intent_terms(text: Column) -> Column:
    """Accent-free one- and two-word terms over tokens of two word characters or more."""
    plain = unicode_normalize(F.lower(text), "NFKD", drop_marks=True)

    def tokens(plain: Column) -> Column:
        # The same words; Unicode classes and borders are looked at only where the text needs them.
        found = [F.regexp_extract_all(plain, F.lit(p), F.lit(0)) for p in (r"(?U)\b\w\w+\b", "[0-9A-Za-z_]{2,}")]
        return F.when(plain.rlike(r"[^\x00-\x7F]"), found[0]).otherwise(found[1])

    return let(let(plain, tokens), lambda found: F.concat(found, pairs_of(found)))


def entity_content_tokens(entity: Column) -> Column:
    """Tokens of an entity phrase without determiners; all of them if nothing is left."""
    tokens = F.regexp_extract_all(F.lower(entity), F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0))
    content = F.filter(tokens, lambda t: ~t.isin(K.ENTITY_DETERMINERS))
    return F.when(F.size(content) > 0, content).otherwise(tokens)


def entity_from_query(query: Column) -> Column:
    """The word after "about (my)", else after "my", else "this topic"."""
    name = r"([A-Za-z][A-Za-z'\-]*)"
    about = F.regexp_extract(query, rf"(?i)about\s+(?:my\s+)?{name}", 1)
    mine = F.regexp_extract(query, rf"(?iU)\bmy\s+{name}", 1)
    return F.coalesce(F.nullif(about, F.lit("")), F.nullif(mine, F.lit("")), F.lit("this topic"))


def excerpt(text: Column, entity: Column, n: int = K.EXCERPT_LENGTH) -> Column:
    """The dialogue line that says most about ``entity``, else the first usable line."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    spoken = F.filter(
        F.transform(lines, lambda line: strip(
            F.regexp_extract(line, r"(?iU)\AUser\s+\d+\s*:\s*([^\n]+)\z", 1))),
        lambda body: F.length(body) >= 8)
    tokens = entity_content_tokens(entity)
    phrase = strip(F.lower(entity))

    def scored(body: Column) -> Column:
        lowered = F.lower(body)
        hits = F.size(F.filter(tokens, lambda t: F.contains(lowered, t)))
        bonus = F.when((phrase != "") & F.contains(lowered, phrase), 1).otherwise(0)
        return F.struct((hits + bonus).alias("hits"), F.length(body).alias("size"), body.alias("body"))

    best = F.array_max(F.filter(F.transform(spoken, scored), lambda s: s["hits"] > 0))
    return shorten(F.coalesce(best["body"], F.get(spoken, F.lit(0)), F.array_join(lines, " ")), n)
