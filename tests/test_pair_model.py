"""Fitted pair scorer: features against plain Python, verdicts and calibration on held-out texts, nulls, clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.operators import conflicts, pair_model

PAIRS = "a_text STRING, b_text STRING, a_sentiment DOUBLE, b_sentiment DOUBLE"


def _plain(a, b, sa, sb):
    def jaccard(x, y):
        return len(x & y) / len(x | y) if x | y else 1.0
    wa, wb = (re.findall("[a-z0-9']+", (t or "").lower()) for t in (a, b))
    x, y = set(wa), set(wb)
    na, nb = ({w for w in s if w in K.NUMBER_WORDS or w.isdigit()} for s in (x, y))
    sa, sb = sa or 0.0, sb or 0.0
    sign = [(s > K.SIGN_THRESHOLD) - (s < -K.SIGN_THRESHOLD) for s in (sa, sb)]
    return [jaccard(x, y), len(x & y) / len(x) if x else 1.0, len(x & y) / len(y) if y else 1.0,
            jaccard(set(zip(wa, wa[1:])), set(zip(wb, wb[1:]))),
            float(bool(x & set(K.NEGATIONS)) != bool(y & set(K.NEGATIONS))), float(bool(na and nb) and not na & nb),
            float(sign[0] * sign[1] < 0), abs(sa - sb)]


def test_features(spark):
    rows = [("We have two dogs", "we have three dogs.", 0.5, -0.5), ("", None, None, 0.2), (None, "a b", 0.0, None),
            ("We do not go", "we do go", 0.1, 0.1), ("one one one", "one", 0.0, 0.0), ("the end " * 30_000, "the end", 0.3, 0.4)]
    found = pair_model.features(spark.createDataFrame(rows, PAIRS)).collect()
    got = {(r.a_text, r.b_text): [r[name] for name in pair_model.FEATURES] for r in found}
    for row in rows:
        assert got[row[:2]] == pytest.approx(_plain(*row))


def _texts(spark, n, seed):
    rng = random.Random(seed)
    words = "the cat dog tree house river stone bread water light night road song field green old new big".split()
    return spark.createDataFrame([(f"we saw {rng.choice(['two', 'three', 'no'])} " + " ".join(rng.choices(words, k=rng.randint(6, 14))),)
                                  for _ in range(n)], "text STRING").repartition(3)


def test_fit_and_calibration(spark):
    model = pair_model.fit(pair_model.weak_pairs(_texts(spark, 400, 1)))
    held_out = pair_model.weak_pairs(_texts(spark, 200, 2))
    checked = pair_model.calibration(model.score(held_out)).first()
    assert checked.n > 400 and checked.accuracy > 0.8 and checked.error < 0.1
    pairs = spark.createDataFrame([("we have two dogs at home", "we have two dogs", 0.1, 0.1), ("we go out today", "rain falls again", 0.0, 0.0),
                                   (None, "", None, None)], PAIRS).withColumns({"label": F.lit("x"), "probability": F.lit(1), "shared": F.lit(2)})
    scored = conflicts.score_pairs(pairs, model.score)
    assert {r.a_text: r.verdict for r in scored.collect() if r.a_text} == {"we have two dogs at home": "entailment", "we go out today": "neutral"}
    assert {"label", "probability", "shared"} <= set(scored.columns) and scored.count() == 3
    for r in scored.collect():
        assert r.contradiction_prob + r.entailment_prob + r.neutral_prob == pytest.approx(1, abs=2e-4)
    assert model.score(pairs.limit(0)).count() == 0
    assert pair_model.calibration(model.score(held_out.limit(0))).first().n == 0


def test_weak_pairs(spark):
    texts = spark.createDataFrame([("we have two big dogs",), ("we have two big dogs",), ("too short",), (None,), ("one two three four five",)], "text STRING")
    rows = pair_model.weak_pairs(texts).collect()
    assert {r.a_text for r in rows} == {"we have two big dogs", "one two three four five"}
    assert all(r.a_text != r.b_text for r in rows) and {r.label for r in rows} >= {0, 1}
    assert len(pair_model.weak_pairs(_texts(spark, 300, 5), rows=20).select("key").distinct().collect()) == 20
    assert pair_model.weak_pairs(texts.limit(0)).count() == 0
