"""Whole columns of text as NumPy arrays: words, spans, hashes, per-document sums.

Everything works on the UTF-8 bytes of a few documents at a time, without a
Python loop over words. Hashes only propose; where a result depends on equality
the operators compare the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is handled alone.
PIECE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and where each text begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets.astype(np.int64) - int(offsets[0])


def pieces(
    batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut so that a piece has about ``most`` bytes of text at most."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            start, stop = offsets[first], offsets[last]
            yield (
                batch.slice(first, last - first),
                raw[start:stop],
                offsets[first : last + 1] - start,
            )
            first = last


def owner(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The document that holds each byte position."""
    return np.searchsorted(offsets, places, "right") - 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and document of every word, in text order."""
    return runs(~_SPACE[raw], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and document of every longest stretch of marked bytes, in text order."""
    none = np.zeros(0, np.int64)
    if not len(inside):
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, owner(offsets, starts)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POWERS = [np.zeros(0, _U), np.zeros(0, _U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(n, 1 << 16).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            factors = np.full(size, base, _U)
            factors[0] = 1
            _POWERS[k] = np.multiply.accumulate(factors)
    return _POWERS


class Hasher:
    """Hashes of any spans of one byte array, from one running polynomial."""

    def __init__(self, raw: np.ndarray):
        power, self._inverse = _powers(len(raw) + 1)
        self._sum = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * power[: len(raw)], out=self._sum[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sum[ends] - self._sum[starts]) * self._inverse[starts])

    def grams(self, k: int) -> np.ndarray:
        """The hash of every run of k bytes."""
        n = len(self._sum) - k
        return mixed((self._sum[k:] - self._sum[:n]) * self._inverse[:n])


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash from two, in order."""
    return mixed(left * _U(3) + (right ^ (right >> _U(32))) * _U(0xD6E8FEB86659FD93))


def group_sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(groups, values, minlength=n)[:n]
