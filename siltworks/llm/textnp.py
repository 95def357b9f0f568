"""Vectorised text primitives over Arrow string batches, used inside Spark tasks.

Words are runs of bytes outside ``0x20`` and ``0x09-0x0D``; in UTF-8 these bytes
never occur inside a longer code point, so byte-wise splitting equals splitting
by code points.  Word and shingle identities are 64-bit hashes: two different
shingles share one with probability 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_U = np.uint64
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACES = [0x20, *range(0x09, 0x0E)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
BYTE[SPACES] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
MULTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)
_undo = np.ones(1, np.uint64)
#: Bytes of words that are hashed at a time, or one word.
HASH_BYTES = 65_536
#: Bytes of text that one vectorised step takes; one longer document is its own step.
STEP_BYTES = 2_000_000


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        size = max(n, 256, 2 * len(_pow))
        _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _pow


def unwound(n: int) -> np.ndarray:
    """Inverses of ``powers``, to shift sums of running powers back."""
    global _undo
    if len(_undo) < n:
        size = max(n, 256, 2 * len(_undo))
        _undo = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, pow(int(_BASE), -1, 2**64), np.uint64))])
    return _undo[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the row boundaries in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def binary(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls and the row boundaries in them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], (at - at[0]).astype(np.int64)


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of some rows: ``hash``, byte ``start`` and ``end``, and ``split`` (row r has words split[r]:split[r+1])."""

    def __init__(self, text: np.ndarray, at: np.ndarray, lower: bool = True):
        if lower:
            text = LOWER[text]
        self.text, self.at = text, at
        n = len(text)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.split = np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
            return
        gap = IS_SPACE[text]
        before = np.empty(n, bool)
        before[0], before[1:] = True, gap[:-1]
        first = at[:-1][at[:-1] < n]
        before[first] = True
        self.start = np.flatnonzero(before & ~gap)
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, gap[1:]
        after[first[first > 0] - 1] = True
        self.end = np.flatnonzero(after & ~gap) + 1
        self.split = np.searchsorted(self.start, at)
        if len(self.start):
            self.hash = mix(self._sums())
        else:
            self.hash = np.zeros(0, np.uint64)

    def _sums(self) -> np.ndarray:
        """The sum of each word's bytes times powers of the base, by running sums over some words at a time, so that what is worked on stays near."""
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            first = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, first + HASH_BYTES, "right")))
            n = int(self.end[j - 1] - first)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE[self.text[first : first + n]] * powers(n)[:n], out=total[1:])
            at = self.start[i:j] - first
            out[i:j] = (total[self.end[i:j] - first] - total[at]) * unwound(n)[at]
            i = j
        return out

    def shingles(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return shingles(self.hash, self.split, k, short)


def shingles(h: np.ndarray, split: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, the word at which each starts, and row splits; from word hashes and the rows' splits of them.

    ``short``: a row of 1 to k-1 words has its whole sequence as one shingle.
    """
    n = len(h)
    count = np.diff(split)
    made = np.maximum(count - (k - 1), 0)
    if short:
        made = np.where((count > 0) & (made == 0), 1, made)
    ends = np.concatenate([[0], np.cumsum(made)])
    word = np.arange(ends[-1]) + np.repeat(split[:-1] - ends[:-1], made)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += padded[j : j + n] * MULTS[j]
    out = total[word]
    if short:
        for r in np.flatnonzero((count > 0) & (count < k)):
            a, b = split[r], split[r + 1]
            out[ends[r]] = np.append(h[a:b] * MULTS[: b - a], MULTS[63:] * _U(b - a)).sum(dtype=np.uint64)
    return mix(out), word, ends


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task keeps it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def each(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, boundaries) of the steps of a batch."""
    text, at = rows(batch.column(column))
    for i, j in steps(at, most):
        yield i, j, text[at[i] : at[j]], at[i : j + 1] - at[i]
