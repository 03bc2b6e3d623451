"""Vectorised text primitives for Arrow batches.

A batch's texts are looked at as one array of UTF-8 bytes with offsets. Words are runs of bytes other than
ASCII white space (0x20, 0x09 to 0x0D); A-Z are lower-cased bytewise. Word hashes are 64-bit polynomial hashes over
random byte values, finished by a mixing function, so that equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text looked at at once; a single longer text is one slice.
SLICE_BYTES = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Lower-cased random byte values, the white space mask, the base and its inverse modulo 2**64."""
    values = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lowered = np.arange(256)
    lowered[65:91] += 32
    space = np.zeros(256, dtype=bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    base = 0x9E3779B97F4A7C15 | 1
    return values[lowered], space, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


class _Powers:
    """Growing arrays of powers of the base and of its inverse."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            _, _, base, inverse = tables()
            size = max(n, SLICE_BYTES + 1)
            for name, factor in (("up", base), ("down", inverse)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


@lru_cache(maxsize=1)
def _powers() -> _Powers:
    return _Powers()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts, one after another, and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut at rows so that a slice holds about size bytes of text; longer single texts are whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = column_bytes(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (len + 1 values)."""
    _, space, _, _ = tables()
    inside = ~space[data]
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, dtype=bool)
    if n:
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the lower-cased spans."""
    values, _, _, _ = tables()
    up, down = _powers().get(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:-1], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return splitmix(h ^ (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (len + 1 values)."""
    starts, ends, first = word_spans(data, bounds)
    return span_hashes(data, starts, ends), first


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and the index of each text's first one.

    A text with 1 to n - 1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(first[:-1] - begin[:-1], sizes) + np.arange(begin[-1])
    short = np.repeat(counts < n, sizes)
    out = np.zeros(len(at), dtype=np.uint64)
    last = np.repeat(first[1:], sizes)
    for k in range(n):
        there = at + k
        inside = there < last
        value = np.where(inside, words[np.minimum(there, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(0))
        out = splitmix(out * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(k + 1))
    return np.where(short, splitmix(out), out), begin


def directory(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where in sorted hashes each value of their first bits begins, and their number at the end."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(hashes, starts), len(hashes)).astype(np.int32)


def byte_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, case and all."""
    up, down = _powers().get(len(data) + 1)
    values = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:-1], out=prefix[1:])
    return splitmix(((prefix[starts + sizes] - prefix[starts]) * down[starts]) ^ sizes.astype(np.uint64))
