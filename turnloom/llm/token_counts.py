"""Token counts under a unigram vocabulary, without making the tokens.

The vocabulary is a SentencePiece file's pieces and scores, read as a unigram model: the best segmentation
has the largest sum of scores. An Aho-Corasick automaton lists the pieces that end at each character; dynamic
programming carries the best score up to it and the number of tokens on that path. The rules are those of the
tokenizers library's Unigram model: a character that is no piece itself may be unknown at ten below the lowest
score; of equal sums, the one whose last piece is longer wins; an unknown character counts as its bytes where
the vocabulary has pieces for bytes, else a run of them counts once.

Spaces become ``▁`` and one is put in front of a text that is not empty. Where no piece holds a ``▁`` behind
another character, every segmentation breaks before a run of them, so texts are counted in parts and parts
that come again are looked up. Of a part, only the last characters' sums are kept, as many as the longest
piece has, so memory is constant.

A null text has no tokens. Repeated rows count alike; other columns pass through and one named like the
output is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnloom.llm.arrow import drop_column, mapped

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_PARTS = 200_000


class Counter:
    """Counts tokens of texts; ``pieces`` are (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        lowest = float("inf")
        for piece, score in pieces:
            lowest = min(lowest, score)
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        names = {piece for piece, _ in pieces}
        self.singles = {piece for piece in names if len(piece) == 1}
        self.longest = max(map(len, names), default=1)
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        if any(regex.search(f"[^{SPACE}]{SPACE}", piece) for piece in names):
            self.parts = None
        else:
            # A line feed that no piece holds ends a part as well.
            alone = "" if any("\n" in piece for piece in names) else "\n"
            self.parts = regex.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
        self.cache: dict[str, int] = {}

    def best(self, part: str) -> int:
        """Tokens of the best segmentation of ``part``."""
        if not part:
            return 0
        size = self.longest + 1
        score, count, unknown = [0.0] * size, [0] * size, [False] * size
        ending = self.automaton.iter(part)
        found = next(ending, None)
        for end, character in enumerate(part):
            best, tokens, is_unknown = None, 0, False
            while found is not None and found[0] == end:  # the longest piece comes first
                length, piece_score = found[1]
                before = (end + 1 - length) % size
                total = score[before] + piece_score
                if best is None or total > best:
                    best, tokens = total, count[before] + 1
                found = next(ending, None)
            if character not in self.singles:
                before = end % size
                total = score[before] + self.unknown
                if best is None or total > best:
                    best, is_unknown = total, True
                    if self.bytes:
                        tokens = count[before] + len(character.encode("utf-8", "replace"))
                    else:
                        tokens = count[before] + (not unknown[before])
            at = (end + 1) % size
            score[at], count[at], unknown[at] = best, tokens, is_unknown
        return count[len(part) % size]

    def _counted(self, part: str) -> int:
        n = self.best(part)
        if len(part) < 100:
            if len(self.cache) >= CACHED_PARTS:
                self.cache.clear()
            self.cache[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if self.parts is None or not self.bytes:  # unknown characters may run across parts
            return self.best(text)
        known, total = self.cache, 0
        for part in self.parts.findall(text):
            n = known.get(part)
            total += self._counted(part) if n is None else n
        return total


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[tuple[str, float], ...]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep_text: bool = True) -> DataFrame:
    """``df`` with the number of tokens of ``text`` in ``out``."""
    df = drop_column(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(list(pieces(path)))
        for batch in batches:
            counts = [counter.count(value.as_py() or "") for value in batch.column(text)]
            yield mapped(batch, out, pa.array(counts, pa.int64()), without=() if keep_text else (text,))

    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.LongType())]))
