"""Vectorised word hashing over Arrow batches, shared by the word-window operators.

A text is handled as its UTF-8 bytes. What a word is, is a table of 256 flags
(``word_table``): runs of flagged bytes are words, and a word never crosses a
text's end. A word's 64-bit hash is a polynomial over its bytes, mixed; a
window's hash is a weighted sum of word hashes, mixed again, under a seed, so
that two seeds give two independent keys. Everything is numpy over slices of a
bounded number of bytes, so memory is bounded but for a single text longer
than a slice.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Any odd multiplier serves; it is invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text worked on at a time.
SLICE_BYTES = 400_000
NO_ID = np.iinfo(np.int64).min

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        out = []
        for base in (_BASE, _BASE_INV):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[:] = out
    return _powers[0], _powers[1]


def release() -> None:
    """Gives memory that is free back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)


def of_batches(run):
    """A worker's function of batches that gives its memory back when it is done; the worker lives on, idle or not."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return own


def of_group(run):
    """The same for a function of a group."""

    def own(table):
        try:
            return run(table)
        finally:
            release()

    return own


def of_groups(run):
    """The same for a function of two groups."""

    def own(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return own


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_table(separators: bytes) -> np.ndarray:
    """256 flags: which bytes belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = word_table(b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text: digits, a-z and all that is not ASCII)
ALNUM_WORDS = word_table(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def arrow_text(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off


def arrow_ids(column) -> np.ndarray:
    """An integer column as int64; nulls are NO_ID."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes (one row at least)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span."""
    n = len(buf)
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((buf.astype(U64) + U64(1)) * power[:n], out=sums[1:])
    value = (sums[end] - sums[start]) * inverse[start]
    return mix(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """The words of rows [lo, hi): ``hash``, ``start``, ``end`` (byte places in ``buf``), ``first`` (n + 1 places, by row)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        base, top = int(offsets[0]), int(offsets[-1])
        raw = buf[base:top]
        self.buf = _LOWER[raw] if lower else raw
        n = top - base
        rows = (offsets - base).astype(np.int64)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = table[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[rows] = True
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:n]
        self.start = np.flatnonzero(inside[:n] & (~before[:n] | edge[:n]))
        self.end = np.flatnonzero(before[1:] & (~inside[1:] | edge[1:])) + 1
        self.hash = span_hash(self.buf, self.start, self.end)
        self.first = np.searchsorted(self.start, rows)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def text(self, keep: np.ndarray, lo: int, hi: int) -> bytes:
        """Words lo to hi that are kept, joined by a space."""
        data, s, e = self.buf.tobytes() if not hasattr(self, "_raw") else self._raw, self.start, self.end
        self._raw = data
        return b" ".join([data[s[i] : e[i]] for i in (np.flatnonzero(keep[lo:hi]) + lo).tolist()])


def window_hash(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash for each k words in a row (windows over a row's end must be left out by the caller)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    weights = mix(np.arange(1, k + 1, dtype=U64) * U64(0xA24BAED4963EE407) + U64(seed)) | U64(1)
    total = np.zeros(n, dtype=U64)
    for j in range(k):
        total += words[j : j + n] * weights[j]
    return mix(total + U64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """The places of all windows of k words within their rows."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    return ranges(first[:-1], count)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] times, for all i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.arange(total, dtype=np.int64) - skip + np.repeat(start, count)


def input_bytes(df, column: str) -> int:
    """About how many bytes ``df`` reads: the plan's statistics, or a sum over the column where it has none."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def bucket_count(size: int, each: int = 32 << 20, least: int = 64) -> int:
    """A power of two: buckets of about ``each`` input bytes, ``least`` at least."""
    n = least
    while n * each < size:
        n *= 2
    return n
