"""Quality rules: counts against plain Python, estimates against numpy, verdicts on planted outliers."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import quality_rules as rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    covered = {j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark):
    rng = random.Random(0)
    texts = [None, "", " \n\t", "a", "a " * 30, "é# b c\x0bd\n\n x \nx\n x ", "one two three four five six seven eight " * 3,
             "w " * 7, "w " * 8, "w " * 9, "a b c d e f g h i a b c d e f g h"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + rng.choice(["", "\n", "|\n|"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    for r in rules.counts(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_counts(texts[r.i]), texts[r.i]


def _numbers(spark, rows):
    names = [f"x{i}" for i in range(rules.DIMENSIONS)]
    return spark.createDataFrame([(1, *map(float, r)) for r in rows], "_g LONG, " + ", ".join(f"{n} DOUBLE" for n in names))


def _distances(x, mean, factor):
    return (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)


def _factor(rows):
    return rows.mean(axis=0), np.linalg.cholesky(np.cov(rows.T, bias=True).reshape(6, 6) + np.diag(np.square(rules.FLOORS)))


def _bins(d2):
    return np.floor(8 * np.log2(d2 + 1e-3)).astype(int)


def _scale(bins):
    ordered, counts = np.unique(bins, return_counts=True)
    at = ordered[np.cumsum(counts) >= 0.5 * len(bins)][0]
    return max(1.0, 2.0 ** ((at + 1) / 8) / rules.chi_square(0.5))


def plain_estimate(x, share=0.75, steps=4):
    """Centre and covariance (with the scale in it) of one group, step by step."""
    ordered = np.sort(x, axis=0)
    low, middle, high = (ordered[max(int(np.ceil(p * len(x))) - 1, 0)] for p in (0.25, 0.5, 0.75))
    starts = [(middle, np.diag(np.sqrt((0.7413 * (high - low)) ** 2 + np.square(rules.FLOORS)))), _factor(x)]
    ends = []
    for mean, factor in starts:
        for _ in range(steps):
            bins = _bins(_distances(x, mean, factor))
            before = np.array([(bins < b).sum() for b in bins])
            mean, factor = _factor(x[before < share * len(x)])
        ends.append((np.log(np.diag(factor)).sum(), mean, factor))
    _, mean, factor = min(ends, key=lambda e: e[0])
    bins = _bins(_distances(x, mean, factor))
    mean, factor = _factor(x[2.0 ** ((bins + 1) / 8) <= rules.chi_square(0.975) * _scale(bins)])
    return mean, factor @ factor.T * _scale(_bins(_distances(x, mean, factor)))


def _shrunk(n, own, above, prior):
    w, apart = n / (n + prior), own[0] - above[0]
    return w * own[0] + (1 - w) * above[0], w * own[1] + (1 - w) * above[1] + w * (1 - w) * np.outer(apart, apart)


def plain_distances(x, lang, source, prior=100):
    """The distance of each row from its group's estimate, groups drawn towards languages and those towards all rows."""
    top, out = plain_estimate(x), np.zeros(len(x))
    for up in set(lang):
        rows = np.array([v == up for v in lang])
        middle = _shrunk(rows.sum(), plain_estimate(x[rows]), top, prior)
        for s in {v for v, r in zip(source, rows) if r}:
            mine = rows & np.array([v == s for v in source])
            mean, covariance = _shrunk(mine.sum(), plain_estimate(x[mine]), middle, prior)
            out[mine] = np.sqrt(_distances(x[mine], mean, np.linalg.cholesky(covariance)))
    return out


def test_distances_are_those_of_numpy(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, _document(rng) + rng.choice(["", " # $ %", "!" * 30, "\nA B\nA B"]), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", None]))
            for i in range(160)] + [(500, "one row of its own", "xx", "a"), (501, None, "yy", None), (501, None, "yy", None)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING").repartition(3)
    x = rules.counts(df).select("doc_id", "lang", "source", *(v.alias(f"x{i}") for i, v in enumerate(rules.values()))).toPandas()
    numbers = x[[f"x{i}" for i in range(6)]].to_numpy(float)
    names = [[str(v) for v in x[c].where(x[c].notna(), None)] for c in ("lang", "source")]
    want = sorted(zip(x.doc_id, plain_distances(numbers, *names)))
    for sent in (rules.SENT, 0):  # estimates sent to the tasks, or joined by salted keys
        monkeypatch.setattr(rules, "SENT", sent)
        got = sorted((r.doc_id, r.distance) for r in rules.judge(df).collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([d for _, d in got], [d for _, d in want], rtol=1e-6, atol=1e-9)


def test_tables_of_any_size(spark):
    for n in (1, 29):
        rows = [(i, "some words of a text that is long enough for the plain rules to let it pass by now it is", None, "s") for i in range(n)]
        out = rules.judge(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")).collect()
        assert all(r.kept and r.distance == pytest.approx(0, abs=1e-6) for r in out) and len(out) == n


def test_clashing_columns(spark):
    names = ["x0", "m0", "l0_0", "scale", "d2", "_g", "_up", "row", "own", "n", "_t", "lang", "source", "text", "doc_id"]
    df = spark.createDataFrame([(*range(11), "en", "s", "some words", i) for i in range(3)],
                               ", ".join(f"{n} {'STRING' if n in ('lang', 'source', 'text') else 'INT'}" for n in names))
    out = rules.judge(df)
    assert out.columns == [*names, *rules.COUNTS, "base_failed", "distance", "kept"]
    assert all([r[n] for n in names[:11]] == list(range(11)) for r in out.collect())


def test_estimate_ignores_a_far_fifth(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(1200, 6)) @ np.diag([1, 2, 1, 3, 1, 1]) + 5
    good[:, 1] += good[:, 0]
    bad = rng.normal(size=(300, 6)) + 60
    x = _numbers(spark, np.concatenate((good, bad)))
    found = rules.estimates(x).first()
    assert np.allclose([found[f"m{i}"] for i in range(6)], good.mean(axis=0), atol=0.35)
    factor = np.array([[found[f"l{i}_{j}"] if j <= i else 0 for j in range(6)] for i in range(6)])
    expected = np.cov(good.T) + np.diag(np.square(rules.FLOORS))
    assert np.allclose(np.diag(factor @ factor.T) * found.scale, np.diag(expected), rtol=0.3)
    d2 = rules._with_distance(x.join(rules.estimates(x), "_g")).select("d2", "scale").collect()
    far = [r.d2 > rules.chi_square(1 - 1e-4) * r.scale for r in d2]
    assert sum(far) in range(300, 310)


def test_floors_let_a_tight_group_reject(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 6)) * 0.01 + 1
    rows[0, 2] += 0.29  # a share of symbols that only junk has
    rows[1, 2] += 0.12
    x = _numbers(spark, rows)
    d2 = rules._with_distance(x.join(rules.estimates(x), "_g")).select("x2", "d2", "scale").collect()
    assert [round(r.x2, 1) for r in d2 if r.d2 > rules.chi_square(0.999) * r.scale] == [1.3]


@pytest.mark.parametrize("p, k, value", [(0.5, 6, 5.348), (0.975, 6, 14.449), (0.999, 6, 22.458)])
def test_chi_square(p, k, value):
    assert rules.chi_square(p, k) == pytest.approx(value, rel=0.01)


def _document(rng):
    return ". ".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(6, 14)))
                     for _ in range(rng.randint(4, 20)))


def test_judge(spark):
    rng = random.Random(4)
    docs = [(i, _document(rng), "en" if i % 3 else None, "hot" if i % 4 else f"s{i}") for i in range(500)]
    junk = [(1000 + i, " ".join(w + "###" for w in _document(rng).split()), "en", "hot") for i in range(20)]
    odd = [(2000, None, None, None), (2001, "", "xx", "hot"), (2002, "too short", "en", "hot"), (2003, "same words again " * 40, "en", "hot")]
    df = spark.createDataFrame(docs + junk + junk[:1] + odd, "doc_id LONG, text STRING, lang STRING, source STRING")
    df = df.withColumn("kept", F.lit("mine")).withColumn("distance", F.lit(1))
    out = rules.judge(df).collect()
    assert len(out) == len(docs) + len(junk) + 1 + len(odd)
    kept = collections.Counter(r.doc_id for r in out if r.kept)
    assert not [i for i in kept if i >= 1000]
    assert sum(i < 500 for i in kept) >= 498 - sum(r.base_failed for r in out if r.doc_id < 500)
    assert rules.judge(df.limit(0)).count() == 0


def test_small_groups_are_estimated(spark):
    rng = random.Random(8)
    docs = [(i, _document(rng), "en", f"s{i % 3}") for i in range(90)]
    junk = [(1000 + i, " ".join(w + "###" for w in _document(rng).split()), "en", f"s{i}") for i in range(3)]
    out = rules.judge(spark.createDataFrame(docs + junk, "doc_id LONG, text STRING, lang STRING, source STRING")).collect()
    assert all(r.distance is not None for r in out)
    assert {r.doc_id for r in out if not r.kept and not r.base_failed} == {1000, 1001, 1002}
