"""Vectorised tokenising and hashing of Arrow text batches with numpy, for use inside mapInArrow.

Texts are handled as UTF-8 bytes. A chunk holds whole documents of about CHUNK bytes (more only if one document is
longer), so memory is bounded by the chunk, or by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64

#: Byte classes of the word definitions.
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def not_white() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[list(WHITE)] = False
    return table


def alnum() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z: digits, a-z and all above 7F."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Hasher:
    """64-bit polynomial hashes of byte spans from one prefix sum; lower=True folds A-Z first."""

    def __init__(self, lower: bool, seed: int = 1):
        self.values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919))
        if lower:
            self.values[0x41:0x5B] = self.values[0x61:0x7B]
        self.base = int(mix(np.array([seed + 77], U))[0]) | 5 & ~2
        self.inverse = pow(self.base, -1, 1 << 64)
        self.ups = self.downs = np.ones(1, U)

    def _powers(self, n: int) -> None:
        if len(self.ups) < n + 1:
            size = max(n + 1, CHUNK + (CHUNK >> 2))
            self.ups, self.downs = np.full(size, U(self.base)), np.full(size, U(self.inverse))
            self.ups[0] = self.downs[0] = 1
            np.multiply.accumulate(self.ups, out=self.ups)
            np.multiply.accumulate(self.downs, out=self.downs)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._powers(len(data))
        total = np.empty(len(data) + 1, U)
        total[0] = 0
        np.cumsum(self.values[data] * self.ups[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.downs[starts] + (ends - starts).astype(U))


@dataclass
class Chunk:
    """Documents first..last of a batch: bytes, document bounds, word bounds, words' documents."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def docs(self) -> int:
        return self.last - self.first

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    @property
    def offsets(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the int64 bounds of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, bounds


def chunks(column: pa.Array | pa.ChunkedArray, word_bytes: np.ndarray) -> Iterator[Chunk]:
    """Tokenised chunks of a text column."""
    data, bounds = text_buffers(column)
    n, first = len(bounds) - 1, 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK, side="right")) - 1
        last = min(n, max(last, first + 1))
        part, own = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        inside = word_bytes[part]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edge = own[:-1][own[:-1] < len(part)]
        begins[edge] = inside[edge]
        edge = own[1:][own[1:] > 0] - 1
        stops[edge] = inside[edge]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        counts = np.diff(np.searchsorted(starts, own))
        yield Chunk(first, last, part, own, starts, ends, counts)
        first = last


def grams(words: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (runs may span documents; mask those with gram_mask)."""
    if len(words) < k:
        return np.zeros(0, U)
    n = len(words) - k + 1
    factor = U(int(mix(np.array([seed + 1000], U))[0]) | 1)
    total = words[:n].copy()
    for i in range(1, k):
        total *= factor
        total += words[i : i + n]
    return mix(total)


def gram_mask(counts: np.ndarray, k: int) -> np.ndarray:
    """Which of the runs of grams() lie in one document."""
    total = int(counts.sum())
    if total < k:
        return np.zeros(0, bool)
    ends = np.cumsum(counts)
    room = np.repeat(ends, counts) - np.arange(total)
    return (room >= k)[: total - k + 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
