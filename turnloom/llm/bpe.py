"""BPE encoding and decoding with bounded memory per text.

``encode`` adds the token ids of a text column, ``decode`` turns ids back into the tokenizer's text.
Both read a tokenizers JSON file whose model is a BPE without dropout.

Encoding streams. A text is taken in chunks cut where neither normalisation nor a pre-token can reach
across; a pre-token that does not end in its chunk (a word of any length) goes through ``Transducer``,
which emits a token once no continuation can change it. How far ahead it must look follows from the
merge list (``lookahead``), so a word keeps a constant number of symbols however long it is.

Nulls count as empty texts (no ids); null ids decode to an empty text. Repeated and tied rows are
encoded alike, other columns pass through unchanged, an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.llm.arrow import drop_column, mapped, pieces

CHUNK = 1 << 16
CACHED_WORDS = 400_000  # some 250 bytes each
LONG_WORD = 200
_SPACE = r"\p{White_Space}"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printable))
    return [letters[b] for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], left_part: dict[int, int], length: list[int]) -> int:
    """Symbols after a boundary that can still move it, for merges ``(left, right, result)`` in order.

    Take two texts with a common prefix, and apply the merges in order to both. Their tokens agree up to
    a boundary that starts at the end of the prefix. A merge moves it only if it joins the last agreed
    token, its left part, with a token that begins at the boundary; the boundary then moves back by the
    left part's length. The next merge to move it comes later in the list, and its right part begins with
    that same left part, which therefore is on the right part's chain of left parts. The longest such
    chain of merges bounds the distance.
    """
    reach: dict[int, int] = {}
    longest = 0
    for left, right, _ in merges:
        before, part = 0, right
        while True:
            before = max(before, reach.get(part, 0))
            if part not in left_part:
                break
            part = left_part[part]
        here = before + length[left]
        reach[left] = max(reach.get(left, 0), here)
        longest = max(longest, here)
    return longest


class Tables:
    """What encoding and decoding need of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.names = [""] * size
        for name, i in vocab.items():
            self.names[i] = name
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.names[i] = name
        length = [1] * size
        left_part: dict[int, int] = {}
        merges = []
        after: dict[int, dict[int, int]] = {}
        self.result: list[int] = []
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, result = vocab[a], vocab[b], vocab[a + b]
            if result in left_part:
                raise ValueError(f"two merges make {a + b!r}: the look-ahead bound needs one merge per token")
            left_part[result] = left
            length[result] = length[left] + length[right]
            merges.append((left, right, result))
            after.setdefault(left, {})[right] = order
            self.result.append(result)
        # The rank of a merge, asked by its left part and then by its right part.
        no_merge: dict[int, int] = {}
        self.ranks = [after.get(left, no_merge).get for left in range(size)]
        self.lookahead = lookahead(merges, left_part, length)
        self.length = length
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        kinds = [s["type"] for s in steps]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizer {kinds} is not supported")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        if spec.get("decoder") is None:
            self.pieces, self.separator = [n.encode() for n in self.names], b" "
        else:
            byte = {c: b for b, c in enumerate(letters)}
            self.pieces = [bytes(byte[c] for c in n) if n not in self.special else n.encode() for n in self.names]
            self.separator = b""


@lru_cache(maxsize=4)
def tables(path: str) -> Tables:
    return Tables(path)


def merged(ids: list[int], t: Tables) -> list[int]:
    """Apply the earliest merge that fits, leftmost first, until none fits; changes ``ids``."""
    rank_after, result = t.ranks, t.result
    none = len(result)
    ranks = [rank_after[left](right, none) for left, right in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best == none:
            break
        i = ranks.index(best)
        made = ids[i] = result[best]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = rank_after[made](ids[i + 1], none)
        if i:
            ranks[i - 1] = rank_after[ids[i - 1]](made, none)
    return ids


class Transducer:
    """Tokens of one word whose bytes arrive piece by piece; keeps a constant number of symbols."""

    def __init__(self, t: Tables):
        self.t = t
        self.pending: list[int] = []
        self.final = 0
        self.window = 2 * t.lookahead + 64

    def push(self, data: bytes) -> Iterator[int]:
        """Tokens that no continuation can change after ``data``."""
        inner = self.t.inner
        for start in range(0, len(data), self.window):
            piece = data[start:start + self.window]
            self.pending.extend(map(inner.__getitem__, piece))
            self.final = piece[-1]
            if len(self.pending) <= self.window:
                continue
            # The last symbol may yet turn out to end the word, so it is not known either.
            stable = len(self.pending) - 1 - self.t.lookahead
            done = 0
            for token in merged(list(self.pending), self.t):
                if done + self.t.length[token] > stable:
                    break
                done += self.t.length[token]
                yield token
            del self.pending[:done]

    def finish(self) -> list[int]:
        """The rest of the word."""
        if not self.pending:
            return []
        self.pending[-1] = self.t.last[self.final]
        rest, self.pending = merged(self.pending, self.t), []
        return rest


def _joins_nothing_before(c: str) -> bool:
    """Whether text may be normalised apart before this character."""
    at = ord(c)  # Latin, Cyrillic, Han, Hangul syllables
    return at < 0x300 or 0x400 <= at <= 0x482 or 0x3400 <= at <= 0x9FFF or 0xAC00 <= at <= 0xD7A3


def _lower(text: str) -> str:
    """Lower case letter by letter; a final sigma is like any other."""
    return text.replace("Σ", "σ").lower()


class Words(dict):
    """Ids by word: a word asked for the first time goes through a transducer and is kept."""

    def __init__(self, t: Tables):
        super().__init__()
        self.run = Transducer(t)

    def __missing__(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "replace")
        found = (*self.run.push(data), *self.run.finish())
        if len(data) > LONG_WORD:  # not worth a place
            return found
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """The words known so far, kept from task to task by a worker process."""
    return Words(tables(path))


class Encoder:
    """Ids of whole texts; one encoder serves a task."""

    def __init__(self, t: Tables, chunk: int = CHUNK, known: Words | None = None):
        self.t, self.chunk = t, chunk
        self.word = (Words(t) if known is None else known).__getitem__
        self.split = regex.compile("(" + "|".join(map(regex.escape, t.special)) + ")") if t.special else None
        self.longest_special = max(map(len, t.special), default=0)

    def _cut(self, text: str, start: int) -> tuple[int, bool]:
        """End of the chunk that starts at ``start``, and whether a word may go on behind it."""
        end = start + self.chunk
        if end >= len(text):
            return len(text), False
        for i in range(end, start + self.chunk // 2, -1):
            if text[i] in " \n\t\r":
                return i, False
        for i in range(end, len(text)):
            if text[i] in " \n\t\r":
                return i, False
            if not _joins_nothing_before(text[i]) or "'" in text[max(start, i - 3):i]:
                continue
            near = max(start, i - self.longest_special + 1)
            around = text[near:i + self.longest_special - 1]
            if not (self.split and any(m.start() < i - near < m.end() for m in self.split.finditer(around))):
                return i, True
        return len(text), False

    def encode(self, text: str) -> array:
        out = array("i")
        start, run, kind = 0, None, None
        while start < len(text):
            end, goes_on = self._cut(text, start)
            parts = self.split.split(text[start:end]) if self.split else [text[start:end]]
            start = end
            for k, part in enumerate(parts):
                if k % 2:
                    if run:
                        out.extend(run.finish())
                        run = None
                    out.append(self.t.special[part])
                    continue
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                part = _lower(part)
                at = 0
                if run:
                    more = kind.match(part)
                    if more:
                        out.extend(run.push(more[0].encode("utf-8", "replace")))
                        at = more.end()
                    if at < len(part) or not goes_on or k < len(parts) - 1:
                        out.extend(run.finish())
                        run = None
                if not (goes_on and k == len(parts) - 1):
                    out.extend(chain.from_iterable(map(self.word, self.t.words.findall(part, at))))
                    continue
                for m in self.t.words.finditer(part, at):
                    if m.end() == len(part) and not m[0][-1].isnumeric():
                        run, kind = Transducer(self.t), _LETTERS if _LETTERS.match(m[0]) else _OTHERS
                        out.extend(run.push(m[0].encode("utf-8", "replace")))
                    else:
                        out.extend(self.word(m[0]))
        if run:
            out.extend(run.finish())
        return out


_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(rf"[^{_SPACE}\p{{L}}\p{{N}}]+")


class Decoder:
    """Text of ids that arrive in blocks; a character split over tokens waits for its last byte."""

    def __init__(self, t: Tables):
        self.t = t
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: Iterable[int]) -> str:
        data = self.t.separator.join(map(self.t.pieces.__getitem__, ids))
        if self.begun and data:
            data = self.t.separator + data
        self.begun = self.begun or bool(data)
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``ids``, special tokens' strings read as special tokens.

    A column that is already called ``ids`` is replaced. ``keep_text=False`` leaves the text out.
    """
    df = drop_column(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables(path), known=words(path))
        for batch in pieces(batches):
            flat, ends = array("i"), [0]
            for value in batch.column(text):
                flat.extend(encoder.encode(value.as_py() or ""))
                ends.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32))
            yield mapped(batch, ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                         without=() if keep_text else (text,))

    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with the text that the tokenizer's own decoder makes of ``ids`` in ``out``.

    A file without a decoder gives its tokens' strings joined by one space, one with a byte-level decoder
    the text of their bytes. A column that is already called ``out`` is replaced.
    """
    df = drop_column(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(path)
        for batch in pieces(batches):
            column = batch.column(ids)
            texts = []
            for row in column:
                decoder, values, done = Decoder(t), row.values, []
                for start in range(0, 0 if values is None else len(values), CHUNK):
                    block = values.slice(start, CHUNK).drop_null().to_numpy(zero_copy_only=False).tolist()
                    done.append(decoder.push(block))
                texts.append("".join(done) + decoder.finish())
            yield mapped(batch, out, pa.array(texts, pa.string()), without=() if keep_ids else (ids,))

    fields = [f for f in df.schema.fields if keep_ids or f.name != ids]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))
