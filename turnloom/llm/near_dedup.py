"""Near duplicates by consistent weighted sampling of word shingles.

A document is the weighted set of its shingles (``size`` words): a shingle weighs its count times a damped
IDF, ``1 + idf_weight * log(1 + 1 / share) / log(1 + 1 / rare)`` for the share of documents that hold it, ``rare``
at least. Documents with equal sets are one text. Improved
consistent weighted sampling draws ``bands * rows`` samples of each set; two sets agree in a sample with a
probability equal to their weighted Jaccard similarity. Texts that agree in a whole band are candidates,
their samples estimate the similarity, and candidates not clearly below are verified exactly on their whole
texts. Texts linked by ``threshold`` or more, directly or over others, form a class.

* Document frequencies are counted in ``cells`` hashed cells over all documents. A cell also counts other
  shingles that fall into it. Shingles in less than ``rare`` of the documents weigh the same, so the shingles
  of a few copies weigh as much as those that their edits made.
* First every text is a candidate with one centre, the most connected text that it shares a bucket with: the
  original of many copies is more connected than a copy. This joins most of a large group with a pair a text.
* Then buckets whose texts are not all in one class are compared whole: every text outside the
  bucket's largest class with every text of another class, in blocks of ``block`` by ``block`` texts inside tasks.
  A block gives only links that join two classes, so what leaves the tasks does not grow with the pairs.
* Classes come from repeated joins over the verified links; nothing is gathered on the driver.

Documents without words are never compared; each is a class of its own. Repeated rows and exact copies share
a class without being compared pair by pair. A null id is larger than any other. An empty table gives an empty
table. Columns that carry the names of outputs are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.arrow import mapped
from turnloom.llm.rows import Carried
from turnloom.llm.storage import stored
from turnloom.llm.words import blocks, mix, words

_U = np.uint64
_SEGMENT = 1 << 14
_BLOCK = 1 << 18


@dataclass(frozen=True)
class Settings:
    size: int = 5
    threshold: float = 0.8
    bands: int = 15
    rows: int = 4
    idf_weight: float = 0.5
    rare: float = 0.001
    cells: int = 1 << 20
    block: int = 1024
    #: Candidates whose samples agree in a smaller share are not verified: four standard errors below; 0 verifies all.
    estimate: float = 0.6


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of ``n`` equal parts."""
    grid = np.concatenate((np.linspace(0, 1, 20001) ** 2, np.linspace(1, 40, 40001)[1:]))
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + grid) * np.exp(-grid), grid)


_R = _gamma_quantiles(1 << 16).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


@dataclass
class Shingles:
    """Different shingles of ``n`` texts with their counts, in order of text and hash."""

    n: int
    row: np.ndarray
    hash: np.ndarray
    count: np.ndarray


def shingles(column: pa.Array, size: int) -> Shingles:
    w = words(column)
    row, value, _ = w.windows(size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return Shingles(w.n, row[first], value[first], np.diff(np.append(first, len(row))))


def _cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> _U(64 - (cells - 1).bit_length())).astype(np.int64)


def shingle_weights(docs: DataFrame, text: str, s: Settings) -> np.ndarray:
    """The weight of a shingle by its cell, from the document frequencies of all of ``docs``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(s.cells, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for start, end in blocks(batch.column(0)):
                x = shingles(batch.column(0).slice(start, end - start), s.size)
                np.add.at(found, _cell(x.hash, s.cells), 1)
        if n:
            yield _packed(-1, np.array([n], np.int64))
        for i in range(0, s.cells, _SEGMENT):
            if found[i:i + _SEGMENT].any():
                yield _packed(i // _SEGMENT, found[i:i + _SEGMENT])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.int64)
                sums[i] = sums[i] + counts if i in sums else counts
        for i, counts in sums.items():
            yield _packed(i, counts)

    def _packed(i: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())],
                                          names=["segment", "counts"])

    schema = "segment INT, counts BINARY"
    df, n = np.zeros(s.cells), 0
    for row in docs.select(text).mapInArrow(counted, schema).repartition("segment").mapInArrow(added, schema).collect():
        counts = np.frombuffer(zlib.decompress(bytes(row.counts)), np.int64)  # as many in all as there are cells
        if row.segment < 0:
            n = int(counts[0])
        else:
            df[row.segment * _SEGMENT:row.segment * _SEGMENT + len(counts)] = counts
    share = np.maximum(df / max(n, 1), s.rare)
    return (1 + s.idf_weight * np.log1p(1 / share) / np.log1p(1 / s.rare)).astype(np.float32)


def samples(x: Shingles, weight: np.ndarray, n_samples: int) -> np.ndarray:
    """Hashes of the consistent weighted samples, a row for each text that has shingles."""
    first = np.flatnonzero(np.concatenate(([True], x.row[1:] != x.row[:-1]))) if len(x.row) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(x.row)))
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(first), n_samples), np.uint64)
    low = _U(0xFFFF)
    for k in range(n_samples):
        u = mix(x.hash + _U(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        r = _R[u & low]
        beta = (u >> _U(40)).astype(np.float32) * np.float32(2 ** -24)
        t = np.floor(log_weight / r + beta)
        log_a = _LOG_C[(u >> _U(16)) & low] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, first) if len(first) else log_a
        at = np.flatnonzero(log_a == np.repeat(least, size))
        owner = np.searchsorted(first, at, side="right") - 1
        one = np.ones(len(at), bool)
        one[1:] = owner[1:] != owner[:-1]
        at = at[one]
        out[:, k] = mix(x.hash[at] ^ mix((t[at].astype(np.int64) + 1000).astype(np.uint64)))
    return out


def _keys(x: Shingles, first: np.ndarray) -> np.ndarray:
    """Two hashes of each text's whole set of shingles and counts."""
    term = mix(x.hash + x.count.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return np.stack([np.add.reduceat(term, first), np.add.reduceat(mix(term ^ _U(0x5851F42D4C957F2D)), first)], axis=1)


def signatures(docs: DataFrame, text: str, weights: np.ndarray, s: Settings) -> DataFrame:
    """``docs`` without the text, with the set's ``_key``, its ``_bands`` and its ``_sketch``; null without words."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # four bytes a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            n = batch.num_rows
            keys, bands, sketches = [None] * n, [None] * n, [None] * n
            for start, end in blocks(column, _BLOCK):
                x = shingles(column.slice(start, end - start), s.size)
                if not len(x.row):
                    continue
                first = np.flatnonzero(np.concatenate(([True], x.row[1:] != x.row[:-1])))
                drawn = samples(x, sent.value[_cell(x.hash, s.cells)] * x.count, s.bands * s.rows)
                held = np.zeros((len(first), s.bands), np.uint64)
                for i in range(s.rows):
                    held = mix(held ^ drawn[:, i::s.rows])
                sketch, key = (drawn & _U(255)).astype(np.uint8), _keys(x, first)
                for i, row in enumerate(x.row[first].tolist()):
                    keys[start + row] = key[i].tobytes()
                    bands[start + row] = held[i].view(np.int64)
                    sketches[start + row] = sketch[i].tobytes()
            batch = mapped(batch, "_key", pa.array(keys, pa.binary()), without=(text,))
            batch = mapped(batch, "_bands", pa.array(bands, pa.list_(pa.int64())))
            yield mapped(batch, "_sketch", pa.array(sketches, pa.binary()))

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([
        *fields, T.StructField("_key", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType())),
        T.StructField("_sketch", T.BinaryType())]))


def buckets(texts: DataFrame, s: Settings) -> DataFrame:
    """``band, h, m, _key``: the members of every bucket of ``m > 1`` texts."""
    rows = texts.select("_key", F.posexplode("_bands").alias("band", "h"))
    sizes = rows.groupBy("band", "h").agg(F.count("*").alias("m")).filter(F.col("m") > 1)
    return rows.join(sizes, ["band", "h"])


def central_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: every text with one centre, the most connected text of all its buckets; at most a pair a text.

    Most connected is the text whose buckets are largest: the original of many copies rather than a copy.
    """
    reach = members.groupBy("_key").agg(F.sum("m").alias("reach"))
    centres = members.join(reach, "_key").groupBy("band", "h").agg(F.max(F.struct("reach", "_key")).alias("c"))
    return (members.join(centres, ["band", "h"]).groupBy("_key").agg(F.max("c").alias("c"))
            .select("_key", F.col("c._key").alias("c")).filter("_key <> c")
            .select(F.least("_key", "c").alias("a"), F.greatest("_key", "c").alias("b")).distinct())


_BLOCK_KEYS = ["band", "h", "q", "p"]


def open_blocks(members: DataFrame, texts: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """Rows of the blocks that compare buckets of several classes: ``_BLOCK_KEYS, side, stray, _key, root, …``.

    Side 0 has the strays, the texts outside the bucket's largest class, in parts ``q``; side 1 has all texts, in
    parts ``p``.
    """
    rooted = (members.join(roots, "_key", "left")
              .select("band", "h", "m", "_key", F.coalesce("_root", "_key").alias("root")))
    largest = (rooted.groupBy("band", "h", "root").agg(F.count("*").alias("n")).groupBy("band", "h")
               .agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("all"))
               .filter(F.col("x.n") < F.col("all"))
               .select("band", "h", F.col("x.root").alias("most"), (F.col("all") - F.col("x.n")).alias("strays")))
    dealt = rooted.join(largest, ["band", "h"]).join(texts.select("_key", "_sketch", "_bands"), "_key")
    parts, stray_parts = (F.ceil(F.col(c) / s.block).cast("int") for c in ("m", "strays"))
    own = F.pmod(F.xxhash64("_key", "band", F.lit(1)), F.lit(1 << 30)).cast("int")

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    columns = ["_key", "root", "_sketch", "_bands"]
    stray = F.col("root") != F.col("most")
    left = (dealt.filter(stray).select("band", "h", F.pmod(own, stray_parts).alias("q"), all_of(parts).alias("p"),
                                       F.lit(0).alias("side"), F.lit(True).alias("stray"), *columns))
    right = dealt.select("band", "h", all_of(stray_parts).alias("q"), F.pmod(own, parts).alias("p"),
                         F.lit(1).alias("side"), stray.alias("stray"), *columns)
    return left.unionByName(right)


def _by_block(rows: DataFrame) -> DataFrame:
    """``rows`` dealt and sorted so that each block comes in one task, its strays first, in the same order always."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS, "side", "_key")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Block, side and rows, piece by piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_BLOCK_KEYS, "side")], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(axis=1))))
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(marks)]):
            yield tuple(marks[start, :4].tolist()), int(marks[start, 4]), batch.slice(start, end - start)


class _Side:
    """Arrays of some rows of a block."""

    def __init__(self, rows: pa.RecordBatch, s: Settings):
        self.n = rows.num_rows
        self.key = np.array(rows.column("_key").to_pylist(), dtype="V16")
        self.root = np.array(rows.column("root").to_pylist(), dtype="V16")
        self.order = self.key.view(">u8").reshape(-1, 2)
        self.stray = rows.column("stray").to_numpy(zero_copy_only=False)
        self.sketch = np.frombuffer(b"".join(rows.column("_sketch").to_pylist()), np.uint8).reshape(self.n, -1)
        self.bands = rows.column("_bands").flatten().to_numpy(zero_copy_only=False).reshape(self.n, s.bands)


def _candidates(left: _Side, right: _Side, j: int, band: int, s: Settings) -> np.ndarray:
    """Texts on the left that ``right``'s text ``j`` is to be compared with in this bucket.

    Pairs in one class, pairs that an earlier band compares and the second turn of two strays are left out.
    """
    i = np.flatnonzero((left.sketch == right.sketch[j]).mean(axis=1) >= s.estimate)
    i = i[left.root[i] != right.root[j]]
    if right.stray[j] and len(i):
        a, b = left.order[i], right.order[j]
        i = i[(a[:, 0] < b[0]) | ((a[:, 0] == b[0]) & (a[:, 1] < b[1]))]
    return i[~(left.bands[i, :band] == right.bands[j, :band]).any(axis=1)] if len(i) else i


def block_candidates(rows: DataFrame, s: Settings) -> DataFrame:
    """The block rows that have a candidate, ``_BLOCK_KEYS, side, _key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = None, []
        for now, side, piece in _runs(batches):
            if now != block:
                block, left = now, []
            if not side:
                left.append(_Side(piece, s))
                continue
            right = _Side(piece, s)
            for x in left:
                hit, other = np.zeros(x.n, bool), np.zeros(right.n, bool)
                for j in range(right.n):
                    i = _candidates(x, right, j, block[0], s)
                    hit[i] = True
                    other[j] = len(i) > 0
                keys = [*x.key[hit].tolist(), *right.key[other].tolist()]
                sides = [0] * int(hit.sum()) + [1] * int(other.sum())
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([v] * len(keys), t) for v, t in zip(block, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))),
                         pa.array(sides, pa.int32()), pa.array([bytes(k) for k in keys], pa.binary())], names=[*_BLOCK_KEYS, "side", "_key"])

    return _by_block(rows).mapInArrow(run, "band INT, h BIGINT, q INT, p INT, side INT, _key BINARY").distinct()


class _Texts:
    """Weighted shingles of the left side, for one text to be held against many."""

    def __init__(self, column: pa.Array, weights: np.ndarray, s: Settings):
        x = shingles(column, s.size)
        self.known, self.id = np.unique(x.hash, return_inverse=True)
        self.weight = x.count * weights[_cell(x.hash, s.cells)].astype(float)
        self.start = np.searchsorted(x.row, np.arange(x.n + 1))
        self.total = np.bincount(x.row, self.weight, minlength=x.n)
        self.held = np.zeros(len(self.known))

    def similarity(self, i: np.ndarray, y: Shingles, weights: np.ndarray, cells: int) -> np.ndarray:
        """Weighted Jaccard similarity of the texts ``i`` with the one in ``y``."""
        w = y.count * weights[_cell(y.hash, cells)].astype(float)
        at = np.minimum(np.searchsorted(self.known, y.hash), len(self.known) - 1)
        both = self.known[at] == y.hash
        self.held[at[both]] = w[both]
        size = self.start[i + 1] - self.start[i]
        begin = np.cumsum(size) - size
        flat = np.arange(size.sum()) + np.repeat(self.start[i] - begin, size)
        shared = np.add.reduceat(np.minimum(self.held[self.id[flat]], self.weight[flat]), begin)
        self.held[at[both]] = 0
        return shared / (self.total[i] + w.sum() - shared)


def block_links(rows: DataFrame, weights: np.ndarray, s: Settings) -> DataFrame:
    """``a, b, similarity``: links that join classes within each block; ``rows`` has ``_text`` too."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left, parent = None, [], {}

        def top(x: bytes) -> bytes:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for now, side, piece in _runs(batches):
            if now != block:
                block, left, parent = now, [], {}
            texts = piece.column("_text")
            if not side:
                for start, end in blocks(texts, _BLOCK):
                    part = piece.slice(start, end - start)
                    left.append((_Side(part, s), _Texts(part.column("_text"), sent.value, s)))
                continue
            right, out = _Side(piece, s), []
            for j in range(right.n):
                y = None
                for x, held in left:
                    i = _candidates(x, right, j, block[0], s)
                    mine = top(bytes(right.root[j]))
                    i = i[[top(bytes(r)) != mine for r in x.root[i]]] if len(i) else i
                    if not len(i):
                        continue
                    y = y or shingles(texts.slice(j, 1), s.size)
                    similarity = held.similarity(i, y, sent.value, s.cells)
                    for k, v in zip(i.tolist(), similarity.tolist()):
                        a, b = top(bytes(x.root[k])), top(bytes(right.root[j]))
                        if v >= s.threshold and a != b:
                            parent[a] = b
                            out.append((*sorted((bytes(x.key[k]), bytes(right.key[j]))), v))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64()))],
                                                 names=["a", "b", "similarity"])

    return _by_block(rows).mapInArrow(run, "a BINARY, b BINARY, similarity DOUBLE")


def not_ruled_out(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs whose samples agree often enough."""
    sketches = texts.select("_key", "_sketch")
    drawn = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= s.estimate))

    return drawn.select("a", "b", "x", "y").mapInArrow(close, "a BINARY, b BINARY")


def weighted_jaccard(x: Shingles, y: Shingles, weights: np.ndarray, cells: int) -> float:
    """Similarity of two texts; each argument holds one."""
    wx, wy = (v.count * weights[_cell(v.hash, cells)].astype(float) for v in (x, y))
    at = np.searchsorted(y.hash, x.hash)
    at[at == len(y.hash)] = 0
    both = y.hash[at] == x.hash if len(y.hash) else np.zeros(len(x.hash), bool)
    shared = np.minimum(wx[both], wy[at[both]]).sum()
    union = wx.sum() + wy.sum() - shared
    return float(shared / union) if union else 0.0


def links(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, s: Settings) -> DataFrame:
    """``a, b, similarity`` of the pairs that reach ``threshold``; ``texts`` has ``_key`` and ``_text``."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    joined = (pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Shingles] = {}
        for batch in batches:
            found = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                for key, c in ((a, "x"), (b, "y")):
                    if key not in known:
                        if sum(len(v.hash) for v in known.values()) > 500_000 or len(known) >= 500:
                            known.clear()
                        known[key] = shingles(batch.column(c).slice(i, 1), s.size)
                x = known.get(a) or shingles(batch.column("x").slice(i, 1), s.size)
                found.append(weighted_jaccard(x, known[b], sent.value, s.cells))
            similarity = np.array(found)
            out = batch.select(["a", "b"])
            yield mapped(out, "similarity", pa.array(similarity)).filter(pa.array(similarity >= s.threshold))

    return joined.select("a", "b", "x", "y").mapInArrow(verified, "a BINARY, b BINARY, similarity DOUBLE")


def components(edges: DataFrame) -> DataFrame:
    """``_key, _root``: the smallest key of each linked text's class.

    Every round a text takes the smallest root among itself and its neighbours, then its root's root, until
    nothing changes; the distance to the smallest key halves at least every other round.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "dedup-edges")
    now = both.groupBy(F.col("a").alias("_key")).agg(F.min("b").alias("m")).select("_key", F.least("_key", "m").alias("_root"))
    now, before = stored(now, "dedup-roots"), None
    while True:
        reached = (both.join(now.toDF("b", "_root"), "b").groupBy(F.col("a").alias("_key")).agg(F.min("_root").alias("m"))
                   .join(now, "_key").select("_key", F.least("m", "_root").alias("_root"), F.col("_root").alias("_old")))
        jumped = (reached.join(now.select(F.col("_key").alias("_k"), F.col("_root").alias("_r")), F.col("_root") == F.col("_k"), "left")
                  .select("_key", F.least("_root", F.coalesce("_r", "_root")).alias("_root"), "_old"))
        now = stored(jumped, "dedup-roots")
        if now.filter("_root <> _old").isEmpty():
            return now.select("_key", "_root")
        now = now.select("_key", "_root")


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, weights: np.ndarray, s: Settings) -> DataFrame:
    """Links among ``pairs`` of keys, whose texts are looked up in ``docs``."""
    asked = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct()
    return stored(links(pairs, _held(asked, texts, docs), weights, s), "dedup-links")


def _held(asked: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``_key, _text`` of the keys in ``asked``."""
    wanted = texts.select("_key", F.col("_h").alias("_w")).join(asked, "_key")
    return stored(docs.select("_text", F.xxhash64("_text").alias("_w")).join(wanted, "_w")
                  .groupBy("_key").agg(F.first("_text").alias("_text")), "dedup-held")


def _finished(found: DataFrame, members: DataFrame, texts: DataFrame, docs: DataFrame, weights: np.ndarray, s: Settings) -> DataFrame:
    """Links between the classes that ``found`` makes, from all pairs of all buckets that hold several classes."""
    rows = stored(open_blocks(members, texts, components(found), s), "dedup-blocks")
    chosen = stored(block_candidates(rows, s), "dedup-chosen")
    held = _held(chosen.select("_key").distinct(), texts, docs)
    return stored(block_links(rows.join(chosen, [*_BLOCK_KEYS, "side", "_key"]).join(held, "_key"), weights, s), "dedup-links")


def _classified(docs: DataFrame, s: Settings) -> DataFrame:
    """``_id, _h, class_id, class_size`` of each row of ``docs(_id, _text)``; ``_h`` is the text's hash."""
    weights = shingle_weights(docs, "_text", s)
    signed = stored(signatures(docs.withColumn("_h", F.xxhash64("_text")), "_text", weights, s), "dedup-signatures")
    # Equal sets may differ in punctuation: one of their texts stands for all, the one with the smallest hash.
    texts = stored(signed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.min("_h").alias("_h"), F.first("_bands").alias("_bands"), F.first("_sketch").alias("_sketch")), "dedup-texts")
    members = stored(buckets(texts, s), "dedup-buckets")
    pairs = stored(not_ruled_out(central_pairs(members), texts, s), "dedup-pairs")
    central = _verified(pairs, texts, docs, weights, s)
    roots = components(central.unionByName(_finished(central, members, texts, docs, weights, s)))
    known = texts.select("_key").join(roots, "_key", "left").select("_key", F.coalesce("_root", "_key").alias("_root"))
    smallest = (signed.filter(F.col("_key").isNotNull()).groupBy("_key")
                .agg(F.min("_id").alias("i"), F.count("*").alias("n")).join(known, "_key"))
    of_class = smallest.groupBy("_root").agg(F.min("i").alias("class_id"), F.sum("n").alias("n"))
    by_key = stored(smallest.select("_key", "_root").join(of_class, "_root").select("_key", "class_id", "n"), "dedup-classes")
    return signed.select("_id", "_h", "_key").join(by_key, "_key", "left").select(
        "_id", "_h", F.when(F.col("_key").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("class_size"))


def _narrow(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, class_id, class_size, first``: a row per row of ``docs``.

    ``class_id`` is the smallest id of the class, ``class_size`` its number of rows, and ``first`` says whether this
    row's id is the class id.
    """
    return _classified(_narrow(docs, text, doc_id), settings).select(
        F.col("_id").alias(doc_id), "class_id", "class_size", F.col("_id").eqNullSafe(F.col("class_id")).alias("first"))


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Of rows that repeat both id and text one stays.
    """
    own = Carried(docs)
    rows = stored(_classified(_narrow(docs, text, doc_id), settings), "dedup-rows")
    counted = rows.groupBy("_id", "_h").agg(
        F.max(F.col("_id").eqNullSafe(F.col("class_id"))).alias("first"), F.count("*").alias("n"))
    changed = stored(counted.filter(~F.col("first") | (F.col("n") > 1)).withColumnsRenamed({"_id": "_rid", "_h": "_rh"}), "dedup-changed")
    work = docs.select(own.packed(), F.col(f"`{doc_id}`").alias("_id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("_h"))
    same = work["_id"].eqNullSafe(changed["_rid"]) & work["_h"].eqNullSafe(changed["_rh"])
    kept = work.join(changed, same, "left_anti")
    again = changed.filter("first")
    if not again.isEmpty():
        same = work["_id"].eqNullSafe(again["_rid"]) & work["_h"].eqNullSafe(again["_rh"])
        kept = kept.unionByName(work.join(again, same, "left_semi").dropDuplicates(["_id", "_h"]))
    return kept.select(*own.columns())
