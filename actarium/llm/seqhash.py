"""Numpy helpers on packed texts: words, rolling hashes, window minima. They run inside Arrow batches, a few MB at a time.

Texts are packed into one byte buffer with a newline after each, so that neither words nor hashes run across two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
#: Bytes that separate words: space and 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
CHUNK_BYTES = 1 << 20


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2**64; kept per process."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[kind] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hash of any stretch of a symbol sequence in constant time."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        x = symbols.astype(np.uint64) + np.uint64(0x1F3D)
        x *= _powers("up", _BASE, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers("down", _INVERSE, self.n + 1)[start], seed)

    def grams(self, k: int, seed: int = 0) -> np.ndarray:
        """Hashes of all k-grams, by start."""
        m = self.n - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:m]) * _powers("down", _INVERSE, self.n + 1)[:m], seed)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each stretch of w values, by start."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every stretch, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at is not None and len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, packed bytes, starts) of stretches of rows with about `limit` bytes; a longer text stands
    alone. starts has one entry per row plus the end; each text is followed by a newline."""
    data, offsets = raw(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        lengths = np.diff(offsets[first:end + 1])
        starts = np.zeros(end - first + 1, np.int64)
        np.cumsum(lengths + 1, out=starts[1:])
        buf = np.full(int(starts[-1]), 10, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[starts[1:] - 1] = False
        buf[inside] = data[offsets[first]:offsets[end]]
        yield first, end, buf, starts
        first = end


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a packed buffer, which ends in white space."""
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the first word of every text (one entry more than texts)."""
    begin, end = word_bounds(buf)
    return Rolling(buf).of(begin, end), begin, end, np.searchsorted(begin, starts)


def segments(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
