"""Numpy helpers over Arrow text columns: words, code points and hashes of their runs, a whole batch at a time.

All arithmetic is on unsigned 64-bit integers and wraps around, as hashes may.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
STEP = U(0xD6E8FEB86659FD93)
#: Bytes or code points worked on at once; a longer text is a piece of its own.
PIECE = 1 << 18

_sep = np.zeros(256, bool)
_sep[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = np.atleast_1d(h)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_byte = mixed(np.arange(1, 257, dtype=U) * ODD) | U(1)


def power(base: int, n: int) -> np.uint64:
    return U(pow(int(base), n, 1 << 64))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` units each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` in ``data``; the first word of each text, and their number last."""
    gap = _sep[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = ~gap[edges]
    ends = ~gap
    ends[:-1] &= gap[1:]
    edges = offsets[1:][offsets[1:] > 0] - 1
    ends[edges] = ~gap[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    size = stops - starts
    within = np.arange(len(data), dtype=np.int64)
    reach = np.diff(np.append(starts, len(data)))
    within[starts[0] :] -= np.repeat(starts, reach)
    base = STEP + U(2 * seed)
    powers = np.ones(int(size.max()) + 1, U)
    powers[1:] = base
    powers = np.multiply.accumulate(powers)
    worth = _byte[data]
    worth *= powers[np.minimum(within, len(powers) - 1)]
    worth[_sep[data]] = 0
    return mixed(np.add.reduceat(worth, starts) + size.astype(U) * ODD)


def runs(h: np.ndarray, k: int, base: int = int(ODD)) -> np.ndarray:
    """A hash of every ``k`` consecutive elements, by doubling: as many as there are starts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = part[:n] if out is None else out * power(base, size) + part[done : done + n]
            done += size
        if size * 2 > k:
            return mixed(out)
        part = part[:-size] * power(base, size) + part[size:]
        size *= 2


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of each."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets
