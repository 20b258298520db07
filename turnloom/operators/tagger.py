"""Mentions beyond a gazetteer: a linear-chain tagger trained on turns that a gazetteer has labelled.

Every word of a turn gets a tag, ``O`` or the begin or inside of a label. Words and their neighbours are described by
hashed features; a chain's score is the sum of its words' weights and of the moves between tags, and the best
chain is found by Viterbi's recursion. Training mixes parameters: each round, every shard of the turns trains a
structured perceptron from the same weights, and the shards' averages are averaged. Words separated by anything
but one space belong to different chains, so a chain is short however long its text.

``extractor(model)`` takes the place of ``entities.gazetteer_mentions`` in the plans. Every turn given is learned from
in every round, and every turn is tagged, both over the whole text. The number of shards grows with the text, so that
none holds much more than ``SHARD_CHARS``; a shard is encoded once and stored as one row.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators import entities
from turnloom.scaling import stored

SHARDS = 8  # at least
SHARD_CHARS = 8_000_000
ROUNDS = 5
_ONE = 1 << 24  # sums of weights are whole multiples of 1 / _ONE, so their order does not matter
_AHEAD = 8_192  # words tagged at once in training
_WORDS = 1 << 16  # texts are tagged together up to so many words
BITS = 14  # rows of the weight table: 2^14 hashed features

_WORD = regex.compile(r"[\w'-]+")
_MADE = ("run", "start", "entity", "label")


@dataclass
class Model:
    """``weights[feature, tag]`` and ``moves[tag before, tag]``, whose last row is the start of a chain."""

    tags: list[str]
    weights: np.ndarray
    moves: np.ndarray


def tags_of(labels: list[str]) -> list[str]:
    return ["O", *(f"{part}-{label}" for label in labels for part in "BI")]


def barred(tags: list[str]) -> np.ndarray:
    """Moves that no chain may take: into the inside of a label from anything but the same label."""
    before = [*tags, "O"]
    return np.array([[tag[0] == "I" and b[2:] != tag[2:] for tag in tags] for b in before])


def chains(text: str) -> Iterator[tuple[int, list[str]]]:
    """``first offset, words`` of each series of words with single spaces between them."""
    start, end, words = 0, 0, []
    for found in _WORD.finditer(text):
        if words and (found.start() != end + 1 or text[end] != " "):
            yield start, words
            words = []
        if not words:
            start = found.start()
        words.append(found[0])
        end = found.end()
    if words:
        yield start, words


def _shape(word: str) -> str:
    if word.islower():
        return "x"
    if word[:1].isupper():
        return "X" if len(word) > 1 and word.isupper() else "Xx"
    return "9" if word[:1].isdigit() else "."


@lru_cache(maxsize=200_000)
def _own(word: str) -> tuple[int, ...]:
    low, shape = word.lower(), _shape(word)
    return tuple(zlib.crc32(f.encode("utf-8", "replace")) % (1 << BITS) for f in (
        f"w={low}", f"s={shape}", f"p={low[:2]}{shape}", f"e={low[-3:]}{shape}", f"n={min(len(low), 9)}{shape}"))


@lru_cache(maxsize=200_000)
def _near(side: str, word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode("utf-8", "replace")) % (1 << BITS)
                 for f in (f"{side}w={word.lower()}", f"{side}s={_shape(word)}"))


def features(words: list[str]) -> np.ndarray:
    """Hashed features of each word: its form, shape, beginning, end and length, and its neighbours."""
    around = ["", *words, ""]
    return np.array([(*_own(w), *_near("-", around[i]), *_near("+", around[i + 2])) for i, w in enumerate(words)])


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The chain of tags with the largest sum of scores and moves; of equal ones that with the smaller tags, last word first."""
    best = scores[0] + moves[-1]
    back = []
    for row in scores[1:]:
        ways = best[:, None] + moves[:-1]
        came = ways.argmax(axis=0)
        back.append(came)
        best = ways[came, np.arange(len(row))] + row
    chain = [int(best.argmax())]
    for came in reversed(back):
        chain.append(int(came[chain[-1]]))
    return chain[::-1]


def _gold(words: list[str], place: int, at: dict[int, dict], number: dict[str, int]) -> Iterator[int]:
    """Tags of a chain that begins at ``place``, from the mentions by their offset."""
    inside, label = 0, ""
    for word in words:
        if place in at:
            inside, label = at[place]["n"], at[place]["label"]
            yield number[f"B-{label}"]
        else:
            yield number[f"I-{label}"] if inside > 0 else 0
        inside -= 1
        place += len(word) + 1


def _encoded(turns: list[tuple[str, list]], tags: list[str]) -> dict[str, np.ndarray]:
    """Chains of ``text, mentions`` one after the other: length of each, word number and tag of each word, features of each word number."""
    number = {tag: i for i, tag in enumerate(tags)}
    numbers: dict[str, int] = {"": 0}
    lengths, words, gold = array("i"), array("i"), array("i")
    for text, mentions in turns:
        at = {m["offset"]: m for m in mentions}
        for offset, chain in chains(text):
            lengths.append(len(chain))
            words.extend([numbers.setdefault(word, len(numbers)) for word in chain])
            gold.extend(_gold(chain, offset, at, number))
    table = np.array([(*_own(w), *_near("-", w), *_near("+", w)) for w in numbers], np.int32)
    return {"lengths": np.array(lengths, np.int32), "words": np.array(words, np.int32), "gold": np.array(gold, np.int32), "table": table}


def _beside(words: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``features`` of the words of all chains, one after the other."""
    ends = np.cumsum(lengths)
    before, after = np.roll(words, 1), np.roll(words, -1)
    before[ends - lengths] = after[ends - 1] = 0  # borders
    found = np.empty((len(words), table.shape[1]), np.int32)
    found[:, :5], found[:, 5:7], found[:, 7:] = table[words, :5], table[before, 5:7], table[after, 7:]
    return found


def _trained(block: dict[str, np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Averaged weights of one pass of the structured perceptron over an encoded shard, begun at ``model``.

    The chains are taken one after the other, but many are tagged at once: up to the first wrong one
    the weights would have been the same, and from the one behind it tagging goes on with the new weights.
    """
    lengths, gold = block["lengths"], block["gold"]
    f, ends = _beside(block["words"], lengths, block["table"]), np.cumsum(lengths)
    weights, moves, stop = model.weights.copy(), model.moves.copy(), barred(model.tags)
    drift_w, drift_m, step = np.zeros_like(weights), np.zeros_like(moves), 0  # changes times the step they came in
    many = 4
    while step < len(lengths):
        start = ends[step] - lengths[step]
        until = max(step + 1, min(step + many, int(np.searchsorted(ends, start + _AHEAD, side="right"))))
        part = slice(start, ends[until - 1])
        found = _best_tags(_summed(weights, f[part]), lengths[step:until], np.where(stop, -np.inf, moves))
        wrong = np.flatnonzero(found != gold[part])
        if not len(wrong):
            step, many = until, 2 * many
            continue
        at = int(np.searchsorted(ends, start + wrong[0], side="right"))
        many, step = 2 * (at - step) + 4, at
        chain = slice(ends[at] - lengths[at], ends[at])
        for tags, sign in ((gold[chain], 1.0), (found[chain.start - start:chain.stop - start], -1.0)):
            before = np.array([len(model.tags), *tags[:-1]])
            for w, m, size in ((weights, moves, sign), (drift_w, drift_m, sign * step)):
                np.add.at(w, (f[chain], tags[:, None]), size)
                np.add.at(m, (before, tags), size)
        step += 1
    return (weights - drift_w / step, moves - drift_m / step) if step else (weights, moves)


def _summed(weights: np.ndarray, f: np.ndarray) -> np.ndarray:
    """``weights[f].sum(axis=1)`` in less memory."""
    total = weights[f[:, 0]]
    for k in range(1, f.shape[1]):
        total += weights[f[:, k]]
    return total


def _placed(text: str, found: list) -> list[dict]:
    """The gazetteer's mentions, given by capitalised run and word in it, by their offset in the text."""
    starts = [m.start() for m in _RUNS.finditer(text)]
    placed = []
    for m in found or []:
        if m["run"] < len(starts):
            words = text[starts[m["run"]]:].split(" ", m["start"])
            offset = starts[m["run"]] + sum(len(w) + 1 for w in words[:m["start"]])
            placed.append({"offset": offset, "n": m["entity"].count(" ") + 1, "label": m["label"]})
    return placed


_RUNS = regex.compile(entities._RUN.replace("(?U)", ""))


def fit(turns: DataFrame, gazetteer: DataFrame, rounds: int = ROUNDS) -> Model:
    """A tagger of the gazetteer's labels, trained on all ``turns(conversation_id, turn_index, text)``.

    Turns are dealt to shards by a hash and learned from whole; null texts are passed over. Without any mention the
    tagger finds none. What reaches the driver is one sum of the shards' weights a round.
    """
    labels = sorted(r.label for r in gazetteer.filter("label IS NOT NULL").select("label").distinct().collect())
    tags = tags_of(labels)
    model = Model(tags, np.zeros((1 << BITS, len(tags))), np.zeros((len(tags) + 1, len(tags))))
    blocks = _blocks(turns, gazetteer.filter("label IS NOT NULL"), tags)
    n_blocks = blocks.count()
    for _ in range(rounds if n_blocks else 0):
        sums = blocks.mapInArrow(_pass(model), "place BIGINT, total BIGINT").groupBy("place").agg(
            F.sum("total").alias("total")).toArrow()
        mixed = np.zeros(model.weights.size + model.moves.size)
        mixed[sums.column("place").to_numpy()] = sums.column("total").to_numpy() / (n_blocks * _ONE)
        model = Model(tags, mixed[:model.weights.size].reshape(model.weights.shape),
                      mixed[model.weights.size:].reshape(model.moves.shape))
    return model


def _blocks(turns: DataFrame, gazetteer: DataFrame, tags: list[str]) -> DataFrame:
    """One row a shard: all its turns with the gazetteer's tags, ``_encoded``.

    Turns are numbered in the order of a hash and dealt out by their number, so equal rows fill no shard of their own.
    """
    hashed = turns.filter(F.col("text").isNotNull()).select(
        F.xxhash64("conversation_id", "turn_index", "text").alias("h"), "text", F.monotonically_increasing_id().alias("i"))
    every = stored(hashed.orderBy("h", "text", "i").select(F.monotonically_increasing_id().alias("i"), "text"), "tagger-turns")
    part = F.shiftright("i", 33)  # the task that wrote the row
    sizes = {r.part: r for r in every.groupBy(part.alias("part")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    firsts = list(accumulate((sizes[p].n if p in sizes else 0 for p in range(max(sizes, default=0))), initial=0))
    number = F.get(F.lit(firsts).cast("array<bigint>"), part.cast("int")) + F.col("i").bitwiseAND((1 << 33) - 1)
    every = every.select(number.alias("conversation_id"), F.lit(0).alias("turn_index"), "text")
    n_shards = max(SHARDS, -(-sum(r.chars for r in sizes.values()) // SHARD_CHARS))
    shard = F.pmod(F.xxhash64("conversation_id"), F.lit(n_shards)).cast("int").alias("shard")
    mentions = entities.gazetteer_mentions(every.select(shard, "conversation_id", "turn_index", "text"), gazetteer)

    def encode(mine: pa.Table, found: pa.Table) -> pa.Table:
        by_turn = defaultdict(list)
        for m in found.to_pylist():
            by_turn[m["turn"]].append(m)
        mine = mine.sort_by("conversation_id")
        block = _encoded([(text.as_py(), _placed(text.as_py(), by_turn[i.as_py()]))
                          for text, i in zip(mine.column("text"), mine.column("conversation_id"))], tags)
        return pa.table({name: pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()) for name, part in block.items()})

    found = mentions.select(F.col("shard").alias("of"), F.col("conversation_id").alias("turn"), "run", "start", "entity", "label")
    return stored(every.select(shard, "conversation_id", "text").groupBy("shard").cogroup(found.groupBy("of"))
                  .applyInArrow(encode, "lengths BINARY, words BINARY, gold BINARY, table BINARY"), "tagger-shards")


def _pass(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.weights.size + model.moves.size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: np.frombuffer(zlib.decompress(batch.column(name)[i].as_py()), np.int32)
                         for name in ("lengths", "words", "gold", "table")}
                block["table"] = block["table"].reshape(-1, 9)
                for part, at in zip(_trained(block, model), (0, model.weights.size)):
                    total[at:at + part.size] += np.rint(part.ravel() * _ONE).astype(np.int64)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(total[places], pa.int64())], names=["place", "total"])

    return train


def _scores(chained: list[list[str]], weights: np.ndarray) -> np.ndarray:
    """Scores of the words of all chains, one after the other, as ``weights[features(words)].sum(axis=1)`` has them."""
    numbers: dict[str, int] = {"": 0}
    ids = [[numbers.setdefault(word, len(numbers)) for word in words] for words in chained]
    flat = np.array([i for chain in ids for i in (*chain, 0)])  # a border after each chain
    own, before, after = (np.array([f(word) for word in numbers]) for f in (
        _own, lambda word: _near("-", word), lambda word: _near("+", word)))
    total = weights[own].sum(axis=1)[flat]
    for table, beside in ((before, np.roll(flat, 1)), (after, np.roll(flat, -1))):
        for k in range(table.shape[1]):
            total += weights[table[:, k]][beside]
    return total[flat > 0]


def _best_tags(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``viterbi`` of many chains side by side, step by step; a chain's words follow each other in ``scores``."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # chains longer than each step
    best = scores[starts] + moves[-1]
    back = np.zeros(scores.shape, np.int16)
    for step in range(1, lengths[0]):
        n = active[step]
        at = starts[:n] + step
        ways = best[:n, :, None] + moves[:-1]
        back[at] = came = ways.argmax(axis=1)
        best[:n] = np.take_along_axis(ways, came[:, None], axis=1)[:, 0] + scores[at]
    tags = np.zeros(len(scores), np.int16)
    tags[starts + lengths - 1] = best.argmax(axis=1)
    for step in range(lengths[0] - 1, 0, -1):
        at = starts[:active[step]] + step
        tags[at - 1] = back[at, tags[at]]
    return tags


def _tagged(texts: list[str | None], model: Model, moves: np.ndarray) -> Iterator[tuple[int, int, str, str]]:
    """``number of the text, place, entity, label`` of the mentions of several texts, in order."""
    held: list[tuple[int, int, list[str]]] = []
    n_words = 0
    for i, text in enumerate(texts):
        place = 0
        for _, words in chains(text or ""):
            held.append((i, place, words))
            place += len(words)
        n_words += place
        if n_words >= _WORDS:
            yield from _found(held, model, moves)
            held, n_words = [], 0
    if held:
        yield from _found(held, model, moves)


def _found(held: list[tuple[int, int, list[str]]], model: Model, moves: np.ndarray) -> Iterator[tuple[int, int, str, str]]:
    lengths = np.array([len(words) for _, _, words in held])
    every = _best_tags(_scores([words for _, _, words in held], model.weights), lengths, moves)
    ends = np.cumsum(lengths)
    for c in np.unique(np.searchsorted(ends, np.flatnonzero(every), side="right")):  # chains with more than O
        i, place, words = held[c]
        chain = every[ends[c] - lengths[c]:ends[c]].tolist()
        begun = None
        for at, tag in enumerate([*chain, 0]):
            name = model.tags[tag]
            if begun is not None and name[0] != "I":
                yield i, place + begun, " ".join(words[begun:at]), model.tags[chain[begun]][2:]
                begun = None
            if name[0] == "B":
                begun = at


def tagged(text: str | None, model: Model, moves: np.ndarray | None = None) -> Iterator[tuple[int, str, str]]:
    """``place, entity, label`` of the mentions of one text; ``place`` counts its words."""
    if moves is None:
        moves = np.where(barred(model.tags), -np.inf, model.moves)
    for _, *mention in _tagged([text], model, moves):
        yield tuple(mention)


def mentions(turns: DataFrame, model: Model) -> DataFrame:
    """Mentions in ``turns(..., text)`` as ``entities.gazetteer_mentions`` gives them, found by ``model``.

    ``run`` is the place of the mention's first word in the text and ``start`` is 0. Null and empty texts hold none.
    Other columns are carried along; columns called like the ones made here are replaced.
    """
    fields = [f for f in turns.schema.fields if f.name != "text" and f.name.lower() not in _MADE]
    carry = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.where(barred(model.tags), -np.inf, model.moves)
        for batch in batches:
            at, found = [], []
            for i, *mention in _tagged(batch.column("text").to_pylist(), model, moves):
                at.append(i)
                found.append(mention)
            kept = batch.select(carry).take(pa.array(at, pa.int64()))
            places, names, labels = ([m[k] for m in found] for k in range(3))
            made = [pa.array(places, pa.int32()), pa.array([0] * len(at), pa.int32()), pa.array(names, pa.string()),
                    pa.array(labels, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*carry, *_MADE])

    made = [T.StructField("run", T.IntegerType()), T.StructField("start", T.IntegerType()),
            T.StructField("entity", T.StringType()), T.StructField("label", T.StringType())]
    return turns.select(*[F.col(f"`{c}`") for c in carry], "text").mapInArrow(run, T.StructType([*fields, *made]))


def extractor(model: Model) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """``model`` in the place of a gazetteer look-up."""
    return lambda turns, gazetteer: mentions(turns, model)


def agreement(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: ``n_found, n_wanted, n_right`` mentions of the same turn, entity and label, with ``precision, recall, f1``."""
    keys = ["conversation_id", "turn_index", "entity", "label"]
    both = found.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("w")).unionByName(
        wanted.select(*keys, F.lit(0).alias("f"), F.lit(1).alias("w")))
    counted = both.groupBy(*keys).agg(F.sum("f").alias("f"), F.sum("w").alias("w"))
    total = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (
        (F.col("f"), "n_found"), (F.col("w"), "n_wanted"), (F.least("f", "w"), "n_right"))])
    return total.withColumns({"precision": F.try_divide("n_right", "n_found"), "recall": F.try_divide("n_right", "n_wanted"),
                              "f1": F.try_divide(2 * F.col("n_right"), F.col("n_found") + F.col("n_wanted"))})
