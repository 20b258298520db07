"""Words and word windows of many texts at once, as numpy arrays over the bytes of an Arrow column.

A word is a run of letters, marks and digits of any script; spaces, punctuation and symbols, ASCII or not, end it.
In scripts that are written without spaces every character with its marks is a word. A-Z and the capitals of
Latin-1 count as lower case. Words and windows are known by 64-bit hashes that are the same in every task.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
_U = np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWERED = _BYTES.copy()
_LOWERED[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = mix(np.arange(1000, 1000 + 4096, dtype=np.uint64)) | _U(1)


# Blocks of scripts written without spaces between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana,
# Han and its extensions, half-width kana).
_UNSPACED = ((0xE00, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
_GAP, _LETTER, _SINGLE, _MARK = range(4)


def _kinds() -> np.ndarray:
    """What each code point is: part of no word, of a word, a word of its own, or a mark on one."""
    out = np.array([_LETTER if unicodedata.category(chr(c))[0] in "LMN" else _GAP for c in range(0x40000)], np.uint8)
    for low, high in _UNSPACED:
        for c in range(low, min(high, 0x3FFFF) + 1):
            if out[c] == _LETTER:
                out[c] = _MARK if unicodedata.category(chr(c))[0] == "M" else _SINGLE
    return np.append(out, np.uint8(_GAP))  # the last one stands for all code points beyond


_KIND = _kinds()


def _wide(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mark the bytes of characters beyond ASCII that belong to words; where words begin, and where they must not."""
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in range(1, 4):
        has = size > k
        point[has] = point[has] << 6 | (data[lead[has] + k] & 0x3F)
    kind = _KIND[np.minimum(point, len(_KIND) - 1)]
    held = kind != _GAP
    for k in range(4):
        inside[lead[held & (size > k)] + k] = True
    single = kind == _SINGLE
    after = lead[single | (kind == _MARK)] + size[single | (kind == _MARK)]
    return np.concatenate((lead[single], after[after < len(data)])), lead[kind == _MARK]


@dataclass
class Words:
    """Words of ``n`` texts: for each word its text's number and its hash, in order."""

    n: int
    row: np.ndarray
    hash: np.ndarray

    def windows(self, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, hash and first word of each window of ``size`` words.

        With ``short``, a text of fewer words has one window of them all.
        """
        count = len(self.hash)
        if count == 0:
            return self.row, self.hash, np.zeros(0, np.int64)
        full = max(count - size + 1, 0)
        total = np.zeros(full, np.uint64)
        for i in range(size):
            total += self.hash[i:i + full] * _PLACE[i]
        first = np.flatnonzero(self.row[:full] == self.row[size - 1:]) if full else np.zeros(0, np.int64)
        row, value = self.row[first], mix(total[first])
        if short:
            begin = np.flatnonzero(np.concatenate(([True], self.row[1:] != self.row[:-1])))
            lengths = np.diff(np.concatenate((begin, [count])))
            begin, lengths = begin[lengths < size], lengths[lengths < size]
            rest = np.zeros(len(begin), np.uint64)
            for i in range(size - 1):
                has = lengths > i
                rest[has] += self.hash[begin[has] + i] * _PLACE[i]
            row, value = np.concatenate((row, self.row[begin])), np.concatenate((value, mix(rest)))
            first = np.concatenate((first, begin))
            order = np.argsort(first, kind="stable")
            row, value, first = row[order], value[order], first[order]
        return row, value, first


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more at the end); nulls are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, one text at least."""
    if not len(column):
        return
    _, bounds = text_bytes(column)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1)
        yield start, min(end, len(column))
        start = end


def words(column: pa.Array) -> Words:
    """Words of the texts in ``column``; meant for one block."""
    data, bounds = text_bytes(column)
    n = len(column)
    if not len(data):
        return Words(n, np.zeros(0, np.int64), np.zeros(0, np.uint64))
    lowered = _LOWERED[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    lowered[capital] += 32
    inside = _IS_WORD[data]
    more, joined = _wide(data, inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[more] = inside[more]
    begins[joined[joined > 0]] = ~inside[joined[joined > 0] - 1]
    at_row = bounds[:-1][(bounds[:-1] < len(data)) & (np.diff(bounds) > 0)]
    begins[at_row] = inside[at_row]
    first = np.flatnonzero(begins)
    if not len(first):
        return Words(n, np.zeros(0, np.int64), np.zeros(0, np.uint64))
    spot = np.flatnonzero(inside)
    word = np.cumsum(begins)[spot] - 1
    term = _CODE[lowered[spot]] * _PLACE[(spot - first[word]) & 4095]
    starts = np.searchsorted(spot, first)
    value = mix(np.add.reduceat(term, starts))
    row = np.searchsorted(bounds, first, side="right") - 1
    return Words(n, row, value)
