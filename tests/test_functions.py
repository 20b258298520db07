import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures, rules, sentiment, style
from turnloom.functions import text as T
from turnloom.functions.sentiment import Lexicon

TEXT = F.col("text")


def test_clean(one):
    assert one(T.clean(TEXT), "Hi!!!!", "sooooo", None, "“A” – ‘b’", "a \t\n b ", "ﬁve ＡＢ", "ok...") == [
        "hi!", "soo", "", "\"a\" - 'b'", "a b", "five ab", "ok."]
    assert one(T.clean_preserve_case(TEXT), "WOWWWW!!!") == ["WOWW!"]


def test_strip_and_counts(one):
    assert one(T.strip(TEXT), "\t a b \r\n", "", " ") == ["a b", "", ""]
    assert one(T.word_count(TEXT), "a  b c ", "", "one") == [3, 0, 1]
    assert one(T.first_token(TEXT), "Send it", ", hi", "Stop!now", "") == ["send", "", "stop", ""]
    assert one(T.shorten(TEXT, 5, " | "), "abcdef", "a\nb", "abcde") == ["abcd…", "a | b", "abcde"]


def test_tokens(one):
    assert one(T.topic_tokens(TEXT, ["the"]), "The dogs' café don't a l'été") == [["dogs", "don't", "l'"]]
    assert one(T.intent_terms(TEXT), "Été à b cd_1") == [["ete", "cd_1", "ete cd_1"]]
    assert one(T.pairs_of(T.words(TEXT)), "a b c", "a", "") == [["a b", "b c"], [], []]


def test_entity_phrases(one):
    assert one(T.entity_from_query(TEXT), "Did I mention anything about my sister?", "where is MY dog-house",
               "hello", "about cats") == ["sister", "dog-house", "this topic", "cats"]
    assert one(T.entity_content_tokens(TEXT), "your sister", "the", "") == [["sister"], ["the"], []]


def test_excerpt(one):
    entity = F.lit("your sister")
    chunk = "User 1: hello my dear friend\nUser 2: my sister is here, your sister"
    long = "User 1: " + "x" * 300
    assert one(T.excerpt(TEXT, entity), chunk, "User 1: short one\nUser 2: tiny", "no prefix\nhere", long, "") == [
        "my sister is here, your sister", "short one", "no prefix here", "x" * 179 + "…", ""]


def test_style_counts(one):
    values = {n: one(c, "I'M HERE, i' A '' don't Gonna?!!", None) for n, c in style.counts(TEXT).items()}
    assert values["n_words"] == [7, 0]
    assert values["n_caps"] == [2, 0]
    assert values["n_contractions"] == [3, 0]
    assert (values["n_question"], values["n_exclaim"]) == ([1, 0], [2, 0])
    mixed = "I' aB BA b'CD ÉAB A'B '' 'X X' X"
    shouted = [w for w in re.findall(K.WORD, mixed) if len(w) >= 2 and w.isupper()]
    assert one(style.counts(TEXT)["n_caps"], mixed) == [len(shouted)]


@pytest.mark.parametrize("compound,exclaim,caps,length,question,label", [
    (-0.3, 0.2, 0.0, 4, 0.0, "frustrated"), (-0.25, 0.0, 0.0, 4, 0.0, "down"), (0.25, 0.2, 0.0, 4, 0, "playful"),
    (0.3, 0.06, 0.0, 4, 0.0, "warm"), (0.3, 0.0, 0.0, 4, 0.0, "content"), (0.0, 0.0, 0.0, 4, 0.08, "curious"),
    (0.0, 0.0, 0.0, 4.3, 0.0, "formal"), (0.0, 0.0, 0.0, 4.2, 0.0, "neutral")])
def test_mood_label(spark, compound, exclaim, caps, length, question, label):
    column = style.mood_label(*[F.lit(float(x)) for x in (compound, exclaim, caps, length, question)])
    assert spark.range(1).select(column).first()[0] == label


def test_daily_labels_of_published_days(spark):
    # compound, exclamation, caps, question, word length, contractions -> mood, tone
    days = [(0.5238, 0.0503, 0.00057, 0.02061, 3.9084, 0.06565, "playful", "casual"),
            (0.5198, 0.04849, 0.00056, 0.02034, 3.9011, 0.06537, "happy", "casual"),
            (-0.5, 0.05, 0.0, 0.0, 4.6, 0.0, "frustrated", "casual"), (-0.2, 0.0, 0.0, 0.0, 4.6, 0.01, "sad", "formal"),
            (0.1, 0.08, 0.0, 0.06, 4.0, 0.0, "curious", "playful"), (0.3, 0.0, 0.0, 0.1, 4.0, 0.0, "neutral", "casual")]
    rows = spark.createDataFrame(days, "c DOUBLE, e DOUBLE, k DOUBLE, q DOUBLE, w DOUBLE, t DOUBLE, mood STRING, tone STRING")
    c, e, k, q, w, t = (F.col(x) for x in "cekqwt")
    wrong = rows.filter((style.daily_mood(c, e, k, q) != F.col("mood")) | (style.daily_tone(e, k, w, t) != F.col("tone")))
    assert wrong.count() == 0


def brute_compound(text, lex):
    """The published rules, written as a plain loop."""
    toks = [t if len(t.strip(string.punctuation)) <= 2 else t.strip(string.punctuation) for t in text.split()]
    low = [t.lower() for t in toks]
    caps = [t == t.upper() and t != t.lower() for t in toks]
    shout = 0 < sum(caps) < len(toks)
    total = 0.0
    for i, word in enumerate(low):
        v = lex.valences.get(word, 0.0)
        if not v:
            continue
        sign = 1 if v > 0 else -1
        v += sign * 0.733 if caps[i] and shout else 0
        for d, damp in zip((1, 2, 3), (1, 0.95, 0.9)):
            j = i - d
            if j < 0 or lex.valences.get(low[j], 0):
                continue
            b = lex.boosters.get(low[j], 0)
            if b:
                v += (1 if v > 0 else -1) * (b + (0.733 if caps[j] and shout else 0)) * damp
            if low[j] in lex.negations:
                v *= -0.74
        if lex.contrast in low:
            c = low.index(lex.contrast)
            v *= 0.5 if i < c else 1.5 if i > c else 1
        total += v
    q = text.count("?")
    amp = min(text.count("!"), 4) * 0.292 + (0 if q <= 1 else q * 0.18 if q <= 3 else 0.96)
    total += amp if total > 0 else -amp if total < 0 else 0
    return round(total / math.sqrt(total * total + 15), 4)


def test_compound_against_brute_force(one):
    lex = Lexicon()
    rng = random.Random(5)
    words = ["good", "BAD", "love", "sad", "very", "barely", "not", "never", "but", "VERY", "and", "the", "great!!",
             "(happy)", "wrong?", "don't", "ok"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(300)]
    got = one(sentiment.compound(TEXT, lex), *texts)
    bad = [(t, g, brute_compound(t, lex)) for t, g in zip(texts, got) if abs(g - brute_compound(t, lex)) > 1.01e-4]
    assert not bad
    assert one(sentiment.compound(TEXT), None, "", "nothing known") == [0.0, 0.0, 0.0]


def test_sign(one):
    value = TEXT.cast("double")
    assert one(sentiment.sign(value), "0.05", "0.051", "-0.051", "-0.05") == ["neutral", "pos", "neg", "neutral"]


def test_measures(spark):
    a = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    row = spark.range(1).select(
        measures.jaccard(a(), a()), measures.jaccard(a("x"), a()), measures.jaccard(a("x", "y"), a("y", "z")),
        measures.concentration(F.lit(0), F.lit(0)), measures.is_concentrated(F.lit(10), F.lit(5)),
        measures.is_concentrated(F.lit(9), F.lit(4)), measures.is_concentrated(F.lit(8), F.lit(4))).first()
    assert list(row) == [1.0, 0.0, pytest.approx(1 / 3), 0.0, False, True, False]


WEAK = [("", "unknown", "empty"), ("Please remind me", "reminder", "kw:reminder"),
        ("Send it now", "action-item", "imperative:send"), ("Send it?", "small-talk", "short-utterance"),
        ("well I have to go there now", "action-item", "kw:need-to"),
        ("yesterday was a tough day for everyone", "emotional-support", "kw:emotion"),
        ("oh hello to all of you", "small-talk", "kw:smalltalk"), ("ok then", "small-talk", "short-utterance"),
        ("the weather is rather mild here", "unknown", "fallback"), ("  book a table for us  ", "action-item", "imperative:book")]
GOLD = [("don't forget the milk", "reminder", "explicit remind-me phrase"),
        ("schedule a call for next week", "reminder", "reminder kw + future time"),
        ("schedule a call with them please", "action-item", "imperative verb 'schedule'"),
        ("I am so sad about all this", "emotional-support", "first-person emotion word"),
        ("they were sad about all this", "unknown", "no rule fired"),
        ("oh that sucks for all of them", "emotional-support", "consoling phrase"),
        ("well we all know i should leave before noon", "action-item", "need-to + deadline"),
        ("good night to every one here", "small-talk", "greeting/closing keyword"),
        ("fine by them", "small-talk", "very short utterance"), (" ", "unknown", "empty")]


def test_rules(one):
    assert one(rules.weak_label(TEXT), *[w[0] for w in WEAK]) == [(w[1], w[2]) for w in WEAK]
    assert one(rules.auto_gold(TEXT), *[g[0] for g in GOLD]) == [(g[1], g[2]) for g in GOLD]
    assert set(K.LABELS) >= {w[1] for w in WEAK + GOLD}


@pytest.mark.parametrize("size", [1, 60, 20_000])
def test_lexicon_of_any_size(one, size):
    valences = {f"word{i}": (i % 7 + 1) / 2 for i in range(size)}
    valences["größe"] = -2.5
    lexicon = Lexicon(valences=valences, boosters={}, negations=())
    texts = ["word0 x", f"word{size - 1} y", "größe z", f"word{size} w"]
    expected = [round(v / (v * v + K.NORMALISATION_ALPHA) ** 0.5, 4) for v in (0.5, ((size - 1) % 7 + 1) / 2, -2.5, 0.0)]
    assert one(sentiment.compound(F.col("text"), lexicon), *texts) == expected
