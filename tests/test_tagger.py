"""Linear-chain tagger: Viterbi against all chains, F1 on held-out turns, unseen names, nulls and long texts."""

import itertools
import random
import zlib

import numpy as np

from turnloom.operators import entities, tagger
from turnloom.plans import entities as plan

LABELS = [("Ann", "PERSON"), ("Ann Lee", "PERSON"), ("Bo", "PERSON"), ("Rome", "GPE"), ("Oslo", "GPE"), ("Lima", "GPE")]


def _turns(spark, n, names=("Ann", "Ann Lee", "Bo"), towns=("Rome", "Oslo", "Lima"), seed=0):
    rng = random.Random(seed)
    rows = [(i, 0, rng.choice([f"Yesterday {a} flew to {b}, it was fun.", f"We met {a} in {b} again!",
                               f"In {b} the food is good. Is {a} here?", "Nothing else happened today, Sorry."]))
            for i, (a, b) in enumerate((rng.choice(names), rng.choice(towns)) for _ in range(n))]
    return spark.createDataFrame(rows, "conversation_id BIGINT, turn_index INT, text STRING").repartition(3)


def _gazetteer(spark):
    return spark.createDataFrame(LABELS, "surface STRING, label STRING")


def test_viterbi_is_the_best_of_all_chains():
    rng = np.random.default_rng(3)
    tags = tagger.tags_of(["A", "B"])
    stop = tagger.barred(tags)
    for n in (1, 2, 4, 5):
        scores = rng.integers(-3, 4, (n, len(tags))).astype(float)
        moves = np.where(stop, -np.inf, rng.integers(-2, 3, stop.shape))
        def total(chain):
            return sum(scores[i, t] + moves[chain[i - 1] if i else -1, t] for i, t in enumerate(chain))
        best = max(total(c) for c in itertools.product(range(len(tags)), repeat=n))
        chain = tagger.viterbi(scores, moves)
        assert total(chain) == best > -np.inf


def test_chains_break_at_anything_but_one_space():
    assert list(tagger.chains("Ann Lee, it's  on\nme")) == [(0, ["Ann", "Lee"]), (9, ["it's"]), (15, ["on"]), (18, ["me"])]
    assert list(tagger.chains("")) == []


def test_held_out_turns_and_unseen_names(spark):
    model = tagger.fit(_turns(spark, 300), _gazetteer(spark))
    assert model.tags == ["O", "B-GPE", "I-GPE", "B-PERSON", "I-PERSON"]
    again = tagger.fit(_turns(spark, 300).repartition(7), _gazetteer(spark))  # the order of rows does not matter
    assert np.array_equal(model.weights, again.weights)
    fresh = _turns(spark, 120, seed=9)
    scored = tagger.agreement(tagger.mentions(fresh, model), entities.gazetteer_mentions(fresh, _gazetteer(spark))).first()
    assert scored.n_wanted > 100 and scored.f1 > 0.97
    unseen = _turns(spark, 60, names=("Zed", "Kim"), towns=("Bonn", "Kyiv"), seed=4)
    labels = spark.createDataFrame([("Zed", "PERSON"), ("Kim", "PERSON"), ("Bonn", "GPE"), ("Kyiv", "GPE")], "surface STRING, label STRING")
    assert tagger.agreement(tagger.mentions(unseen, model), entities.gazetteer_mentions(unseen, labels)).first().f1 > 0.7


def test_any_row(spark):
    model = tagger.fit(_turns(spark, 200), _gazetteer(spark))
    long = " ".join(["We met Ann in Rome again!"] * 20_000)
    rows = [(1 << 60, 0, None, 5, "a"), (2, 0, "", 5, None), (3, 0, "We met Ann in Rome again!", None, "b"),
            (3, 0, "We met Ann in Rome again!", None, "b"), (4, 1, long, 1, "c")]
    turns = spark.createDataFrame(rows, "conversation_id BIGINT, turn_index INT, text STRING, run INT, other STRING")
    found = tagger.mentions(turns, model)
    assert found.columns == ["conversation_id", "turn_index", "other", "run", "start", "entity", "label"]
    assert {(r.conversation_id, r["count"]) for r in found.groupBy("conversation_id").count().collect()} == {(3, 4), (4, 40_000)}
    assert {(r.run, r.entity, r.label) for r in found.filter("conversation_id = 3").collect()} == {(2, "Ann", "PERSON"), (4, "Rome", "GPE")}
    assert tagger.mentions(turns.limit(0), model).count() == 0
    nothing = tagger.fit(turns.limit(0), _gazetteer(spark))
    assert tagger.mentions(turns, nothing).count() == 0
    none = tagger.agreement(found.limit(0), found.limit(0)).first()
    assert none.n_right == 0 and none.f1 is None


def test_in_the_plan(spark):
    turns = _turns(spark, 100).selectExpr("CAST(conversation_id % 5 AS INT) AS day", "*")
    model = tagger.fit(turns, _gazetteer(spark))
    found = plan.scored_mentions(turns, _gazetteer(spark), extractor=tagger.extractor(model))
    assert {"day", "entity", "label", "compound"} <= set(found.columns) and found.count() > 50


def test_many_texts_are_tagged_together(monkeypatch):
    rng, tags = np.random.default_rng(5), tagger.tags_of(["A", "B"])
    model = tagger.Model(tags, rng.normal(size=(1 << tagger.BITS, len(tags))).round(1), rng.normal(size=(len(tags) + 1, len(tags))).round(1))
    moves = np.where(tagger.barred(tags), -np.inf, model.moves)
    words = ["The", "of", "don't", "x9", "Ci", "-"]
    texts = [None, "", *["".join(words[i] + [" ", " ", ", "][i % 3] for i in rng.integers(0, 6, n)) for n in rng.integers(0, 40, 200)]]
    calls, together = [], tagger._best_tags
    monkeypatch.setattr(tagger, "_best_tags", lambda *a: calls.append(1) or together(*a))
    found = [tuple(m) for m in tagger._tagged(texts, model, moves)]
    assert len(calls) == 1
    assert found == [(i, *m) for i, text in enumerate(texts) for m in tagger.tagged(text, model)]
    for text in texts:
        for _, chain in tagger.chains(text or ""):
            scores = model.weights[tagger.features(chain)].sum(axis=1)
            assert np.array_equal(tagger._scores([chain], model.weights), scores)
            assert together(scores, np.array([len(chain)]), moves).tolist() == tagger.viterbi(scores, moves)


def test_every_turn_is_learned_from(spark):
    """A name that only turns beyond the former sample of 4,000 hold is labelled as there."""
    n, rare = 8_000, "We met Qorp in Rome again!"
    share = int((1.3 * 4_000 + 20) / n * (1 << 30))
    turns = spark.range(n).selectExpr(
        "id AS conversation_id", "0 AS turn_index",
        f"IF(pmod(xxhash64(id, 0, '{rare}'), {1 << 30}) >= {share}, '{rare}', concat('We met ', elt(1 + id % 3, 'Ann', 'Bo', 'Zed'), ' in Rome again!')) AS text")
    assert 1_000 < turns.filter(f"text = '{rare}'").count() < 4_000
    gazetteer = spark.createDataFrame([*LABELS, ("Zed", "PERSON"), ("Qorp", "ORG")], "surface STRING, label STRING")
    found = tagger.mentions(turns.limit(2_000), tagger.fit(turns, gazetteer))
    assert {(r.entity, r.label) for r in found.select("entity", "label").distinct().collect()} == {
        ("Ann", "PERSON"), ("Bo", "PERSON"), ("Zed", "PERSON"), ("Qorp", "ORG"), ("Rome", "GPE")}


def _chain_by_chain(turns, model):
    """One pass of the averaged perceptron, written plainly."""
    number = {tag: i for i, tag in enumerate(model.tags)}
    weights, moves, stop = model.weights.copy(), model.moves.copy(), tagger.barred(model.tags)
    sum_w, sum_m, step = np.zeros_like(weights), np.zeros_like(moves), 0
    for text, mentions in turns:
        for offset, words in tagger.chains(text):
            gold = list(tagger._gold(words, offset, {m["offset"]: m for m in mentions}, number))
            f = tagger.features(words)
            found = tagger.viterbi(weights[f].sum(axis=1), np.where(stop, -np.inf, moves))
            for chain, sign in ((gold, 1), (found, -1)) if found != gold else ():
                for i, tag in enumerate(chain):
                    for w, m, size in ((weights, moves, sign), (sum_w, sum_m, sign * step)):
                        w[f[i], tag] += [size * (f[i][:k] == c).sum() + size for k, c in enumerate(f[i])]
                        m[chain[i - 1] if i else -1, tag] += size
            step += 1
    return weights - sum_w / step, moves - sum_m / step


def test_training_ahead_is_training_chain_by_chain():
    rng, words, labels = random.Random(2), ["The", "of", "Ann", "Lee", "Rome", "x9", "it"], {"Ann": "A", "Rome": "B", "The": "B"}
    tags = tagger.tags_of(["A", "B"])
    turns = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", "]) for _ in range(rng.randint(0, 12)))
        turns.append((text, [{"offset": m.start(), "n": 1, "label": labels[m[0]]} for m in tagger._WORD.finditer(text)
                             if m[0] in labels and rng.random() < 0.9]))
    model = tagger.Model(tags, np.zeros((1 << tagger.BITS, len(tags))), np.zeros((len(tags) + 1, len(tags))))
    for _ in range(2):
        wanted = _chain_by_chain(turns, model)
        model = tagger.Model(tags, *tagger._trained(tagger._encoded(turns, tags), model))
        assert np.allclose(model.weights, wanted[0]) and np.allclose(model.moves, wanted[1])
    nothing = tagger._trained(tagger._encoded([("", []), ("...", [])], tags), model)
    assert np.array_equal(nothing[0], model.weights)


def test_shards_hold_all_turns(spark, monkeypatch):
    """Equal rows, null keys and more text than a shard takes: the shards hold every chain of every text, and the same whatever the order."""
    monkeypatch.setattr(tagger, "SHARD_CHARS", 1_000)
    turns = _turns(spark, 300).unionByName(spark.sql(
        "SELECT CAST(NULL AS BIGINT) AS conversation_id, CAST(NULL AS INT) AS turn_index, explode(array_repeat('We met Ann, Bo.', 2000)) AS text"))
    turns = turns.unionByName(turns.limit(1).selectExpr("conversation_id", "turn_index", "CAST(NULL AS STRING) AS text"))
    tags = tagger.tags_of(["GPE", "PERSON"])
    shards = [{c: np.frombuffer(zlib.decompress(r[c]), np.int32) for c in ("lengths", "gold")}
              for r in tagger._blocks(turns, _gazetteer(spark), tags).collect()]
    wanted = sum(len(list(tagger.chains(r.text or ""))) for r in turns.collect())
    assert sum(len(s["lengths"]) for s in shards) == wanted > 4_000
    assert sum((s["gold"] == tags.index("B-PERSON")).sum() for s in shards) == entities.gazetteer_mentions(
        turns.selectExpr("monotonically_increasing_id() AS conversation_id", "0 AS turn_index", "text"), _gazetteer(spark)).filter("label = 'PERSON'").count()
    assert len(shards) > 30 and max(len(s["lengths"]) for s in shards) < wanted / 8
    one, other = (tagger.fit(t, _gazetteer(spark), rounds=2) for t in (turns, turns.repartition(5)))
    assert np.array_equal(one.weights, other.weights) and np.array_equal(one.moves, other.moves) and one.weights.any()
