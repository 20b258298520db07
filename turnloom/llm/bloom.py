"""Bloom filters of 64-bit hashes, built by all tasks and put together segment by segment."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 16
PROBES = 4
_SCHEMA = "segment INT, once BINARY, twice BINARY"


def size_for(keys: int, per_key: int = 16, most: int = 1 << 29) -> int:
    """Bits for so many keys: a power of two, from 2^20 to ``most`` (64 MB by default)."""
    return min(most, max(1 << 20, 1 << max(keys * per_key - 1, 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one row each; ``bits`` is a power of two."""
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * step[:, None]) & np.uint64(bits - 1)


def add(held: np.ndarray, at: np.ndarray) -> None:
    """Set bits, given as ``places`` gives them."""
    at = np.unique(at)
    if len(at):
        byte, mask = at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8)
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        held[byte[first]] |= np.bitwise_or.reduceat(mask, first)


def has(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row are set."""
    shift = (at & np.uint64(7)).astype(np.uint8)
    return ((held[at >> np.uint64(3)] >> shift) & 1).all(axis=1)


def _segment(i: int, once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    packed = (pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice))
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *packed], names=["segment", "once", "twice"])


def build(hashes: DataFrame, bits: int, twice: bool) -> bytes:
    """Filter of the hashes in the first column, an array of different hashes for each row: ``bits / 8`` bytes.

    With ``twice``, of the hashes that two rows have: every task notes what it has met before, and a bit that
    is set in two tasks' filters may have been set by the same hash, so no repeated hash is missed.
    """

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            some, counts = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            at = places(some, bits)
            if twice:
                add(again, at[(counts > 1) | has(once, at)])
            add(once, at)
        for i in range(0, bits // 8, SEGMENT):
            if once[i:i + SEGMENT].any():
                yield _segment(i // SEGMENT, once[i:i + SEGMENT], again[i:i + SEGMENT])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, a, b in zip(*(batch.column(k) for k in range(3))):
                once, again = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (a, b))
                if i.as_py() in held:
                    once_before, again_before = held[i.as_py()]
                    once, again = once | once_before, again | again_before | (once & once_before)
                held[i.as_py()] = once, again
        for i, (once, again) in held.items():
            yield _segment(i, once[:0] if twice else once, again if twice else again[:0])

    wanted = "twice" if twice else "once"
    segments = hashes.mapInArrow(built, _SCHEMA).repartition("segment").mapInArrow(put_together, _SCHEMA)
    whole = np.zeros(bits // 8, np.uint8)
    for row in segments.select("segment", wanted).collect():  # at most bits / 8 bytes
        part = np.frombuffer(zlib.decompress(bytes(row[wanted])), np.uint8)
        whole[row.segment * SEGMENT:row.segment * SEGMENT + len(part)] = part
    return whole.tobytes()
