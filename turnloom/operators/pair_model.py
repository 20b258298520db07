"""A fitted scorer of text pairs: word alignment features and a multinomial model, in place of ``conflicts.rule_scores``.

The model learns from pairs with weak labels that any table of texts yields: a text and a part of it (entailment), a text
and itself with a negation put in or a number exchanged (contradiction), a text and another one (neutral). Its
probabilities are checked on pairs of held-out texts (``calibration``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures, sentiment
from turnloom.functions import text as T
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import conflicts
from turnloom.scaling import stored

FIT_TEXTS = 6_000
FEATURES = ["shared", "a_covered", "b_covered", "neighbours", "negated", "other_numbers", "opposed", "sentiment_gap"]
_PREFIX = "_pair_"  # feature columns stand beside the caller's


def _words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _covered(a: Column, b: Column) -> Column:
    """The share of distinct words of ``a`` that ``b`` holds; 1 for none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def features(pairs: DataFrame, negations: Sequence[str] = K.NEGATIONS, number_words: Sequence[str] = K.NUMBER_WORDS,
             prefix: str = "") -> DataFrame:
    """``pairs`` with the columns ``FEATURES`` (after ``prefix``), made of ``a_text, b_text, a_sentiment, b_sentiment``.

    Null texts count as empty, null sentiments as 0. Two texts without words share all of none: 1.
    """
    sides = pairs.withColumns({f"_pair_words_{s}": _words(F.col(f"{s}_text")) for s in "ab"})
    sides = sides.withColumns({
        **{f"_pair_set_{s}": F.array_distinct(f"_pair_words_{s}") for s in "ab"},
        **{f"_pair_next_{s}": F.array_distinct(T.pairs_of(F.col(f"_pair_words_{s}"))) for s in "ab"}})
    a, b = F.col("_pair_set_a"), F.col("_pair_set_b")
    negation_words = F.array(*[F.lit(w) for w in negations])

    def numbers(words: Column) -> Column:
        return F.filter(words, lambda w: w.isin(list(number_words)) | w.rlike("^[0-9]+$"))

    gap = F.coalesce("a_sentiment", F.lit(0.0)) - F.coalesce("b_sentiment", F.lit(0.0))
    signs = F.concat(*[sentiment.sign(F.coalesce(f"{s}_sentiment", F.lit(0.0))) for s in "ab"])
    values = {
        "shared": measures.jaccard(a, b),
        "a_covered": _covered(a, b),
        "b_covered": _covered(b, a),
        "neighbours": measures.jaccard(F.col("_pair_next_a"), F.col("_pair_next_b")),
        "negated": F.arrays_overlap(a, negation_words) != F.arrays_overlap(b, negation_words),
        "other_numbers": ((F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0)
                          & (F.size(F.array_intersect(numbers(a), numbers(b))) == 0)),
        "opposed": signs.isin("posneg", "negpos"),
        "sentiment_gap": F.abs(gap),
    }
    made = sides.withColumns({prefix + name: value.cast("double") for name, value in values.items()})
    return made.drop(*[f"_pair_{part}_{s}" for part in ("words", "set", "next") for s in "ab"])


def weak_pairs(texts: DataFrame, lexicon: Lexicon | None = None, negations: Sequence[str] = K.NEGATIONS,
               number_words: Sequence[str] = K.NUMBER_WORDS, rows: int = FIT_TEXTS) -> DataFrame:
    """``key, label, a_text, b_text, a_sentiment, b_sentiment`` from at most ``rows`` of ``texts(text)``, chosen by a hash.

    ``label`` is a place in ``conflicts.VERDICTS``. Texts of less than four words are left out; equal texts count once.
    """
    known = texts.select("text", F.xxhash64("text").alias("key")).filter(F.size(_words(F.col("text"))) >= 4)
    share = int(min(1.0, (1.3 * rows + 20) / max(known.count(), 1)) * (1 << 30))
    sample = stored(known.filter(F.pmod("key", F.lit(1 << 30)) < share).dropDuplicates(["key"]).orderBy("key").limit(rows)
                    .withColumn("words", F.split("text", " ")), "pair-texts")
    half = F.array_join(F.slice("words", 1 + F.pmod("key", F.lit(2)).cast("int"), F.greatest(F.size("words") * 3 / 4, F.lit(1)).cast("int")), " ")
    at = (1 + F.pmod(F.shiftright("key", 8), F.size("words"))).cast("int")
    denied = F.array_join(F.array_insert("words", at, F.lit(list(negations)[0])), " ")
    number = rf"(?i)\b(?:[0-9]+|{'|'.join(number_words)})\b"
    recounted = F.regexp_replace("text", number, str(list(number_words)[-1]))
    against = F.when((F.pmod(F.shiftright("key", 16), F.lit(2)) == 0) & (recounted != F.col("text")), recounted).otherwise(denied)
    other = F.lead("text").over(Window.partitionBy(F.pmod("key", F.lit(8))).orderBy("key"))  # eighths of the bounded sample
    kinds = F.array(*[F.struct(F.lit(i).alias("label"), text.alias("b_text")) for i, text in enumerate((against, half, F.col("other")))])
    pairs = sample.withColumn("other", other).select("key", F.col("text").alias("a_text"), F.inline(kinds)).filter("b_text IS NOT NULL")
    return pairs.withColumns({f"{s}_sentiment": sentiment.compound(F.col(f"{s}_text"), lexicon) for s in "ab"})


@dataclass
class PairModel:
    """The fitted model and the word lists its features use; ``PairModel.score`` is a scorer for ``conflicts.score_pairs``."""

    model: LogisticRegressionModel
    negations: Sequence[str]
    number_words: Sequence[str]

    def score(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with the three probabilities of ``conflicts.PROBABILITIES``."""
        kept = [c for c in pairs.columns if c not in conflicts.PROBABILITIES]
        scored = self.model.transform(_assembled(pairs, self.negations, self.number_words))
        found = vector_to_array(F.col(_PREFIX + "probability"))
        return scored.select(*[F.col(f"`{c}`") for c in kept], *[found[i].alias(name) for i, name in enumerate(conflicts.PROBABILITIES)])


def _assembled(pairs: DataFrame, negations: Sequence[str], number_words: Sequence[str]) -> DataFrame:
    columns = [_PREFIX + name for name in FEATURES]
    return VectorAssembler(inputCols=columns, outputCol=_PREFIX + "features").transform(
        features(pairs, negations, number_words, _PREFIX))


def fit(pairs: DataFrame, negations: Sequence[str] = K.NEGATIONS, number_words: Sequence[str] = K.NUMBER_WORDS) -> PairModel:
    """A multinomial logistic regression on labelled pairs, such as ``weak_pairs`` makes."""
    regression = LogisticRegression(
        family="multinomial", regParam=1e-3, maxIter=100, featuresCol=_PREFIX + "features", labelCol="label",
        probabilityCol=_PREFIX + "probability", rawPredictionCol=_PREFIX + "raw", predictionCol=_PREFIX + "prediction")
    rows = _assembled(pairs, negations, number_words).select(F.col("label").cast("double"), _PREFIX + "features")
    return PairModel(regression.fit(rows), negations, number_words)


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row for scored pairs with a ``label``: ``n``, ``accuracy`` and the expected calibration ``error``.

    The error is the mean distance between confidence and accuracy over equal bins of confidence, weighted by their rows.
    """
    probabilities = F.array(*conflicts.PROBABILITIES)
    sure = F.array_max(probabilities)
    right = (F.array_position(probabilities, sure) - 1 == F.col("label")).cast("double")
    binned = scored.select(sure.alias("sure"), right.alias("right"), F.least(F.floor(sure * bins), F.lit(bins - 1)).alias("bin"))
    per_bin = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("right").alias("right"),
                                        F.abs(F.sum("right") - F.sum("sure")).alias("off"))
    return per_bin.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("right") / F.sum("n")).alias("accuracy"),
                       (F.sum("off") / F.sum("n")).alias("error"))
