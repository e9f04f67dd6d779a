"""Vectorised byte, word and line helpers that run inside Arrow tasks.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are handled as UTF-8 bytes; slices of a
few megabytes keep the work arrays of a task small, whatever the batch holds.
Hashes are polynomials modulo 2**64 over mixed symbols, so the hash of any
byte or word range comes from two entries of one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _MIX_A
    x ^= x >> _S33
    x *= _MIX_B
    x ^= x >> _S33
    return x


SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


class Poly:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.size, b, np.uint64)]))
                                  for b in (self.base, self.inverse))
        return self.up, self.down

    def running(self, symbols: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:len(symbols)], out=out[1:])
        return out

    def ranges(self, running: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(running))
        return mix((running[hi] - running[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _MIX_B)

    def windows(self, running: np.ndarray, k: int) -> np.ndarray:
        """Hash of every k consecutive symbols, by start."""
        n = max(0, len(running) - k)
        _, down = self.powers(len(running))
        return mix((running[k:k + n] - running[:n]) * down[:n])


BYTES, WORDS = Poly(0x9E3779B97F4A7C15), Poly(0xD6E8FEB86659FD93)


class Slice:
    """Some consecutive rows of a text column: ``data`` (uint8) and ``off`` (row
    bounds in it). Null texts are empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.rows = data, off, first, len(off) - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """Number of set bytes in each row."""
        run = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=run[1:])
        return run[self.off[1:]] - run[self.off[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the word bounds of the rows."""
        w = ~IS_SPACE[self.data]
        start, end = w.copy(), w.copy()
        start[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        inner = self.off[(self.off > 0) & (self.off < len(w))]
        start[inner] = w[inner]
        end[inner - 1] = w[inner - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        return s, e, np.searchsorted(s, self.off)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of ``col`` in order, as slices of at most ``limit`` bytes (a longer
    row stands alone)."""
    data, off = column_bytes(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield Slice(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lo)
        lo = hi


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return BYTES.ranges(BYTES.running(SYMBOL[data]), s, e)


def windows_in_rows(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and row of every window of ``k`` consecutive symbols that stays in
    its row, for rows that begin at ``bounds``."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + bounds[rows], rows


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window of ``k`` that begins at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:-1]) > 0
