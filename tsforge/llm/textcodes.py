"""Whole texts of an Arrow batch as byte arrays: words, range hashes and window minima in numpy.

A *slab* is a run of consecutive rows of a batch whose UTF-8 bytes lie in one array. Slabs hold
about ``SLAB_BYTES``; a longer text makes a slab of its own, so memory follows the longest text.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20

#: The white space that ends a word, fixed by the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_MASK = (1 << 64) - 1
#: Odd multipliers of the two independent polynomial hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for slabs of the usual size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        size = -(-n // 65536) * 65536
        while len(have) < size:
            have = np.concatenate([have, have[:size - len(have)] * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 2 * SLAB_BYTES:
            _powers[base] = have
    return have[:n]


def forget_powers() -> None:
    """Drop the kept tables; the next slab makes them again."""
    _powers.clear()


class Ranges:
    """Hashes of any ranges of a code sequence, from one running sum."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        n = len(codes)
        self.inverse = powers(_INVERSES[which], n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(BASES[which], n), out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal sequences of equal length; mix() it before use as a number."""
        return (self.total[end] - self.total[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` codes."""
        n = len(self.total) - width
        return (self.total[width:] - self.total[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


class Slab:
    """Rows ``first``..``first + len(self)`` of a batch; ``at`` bounds each text in ``data``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the first word of each text (len + 1 bounds)."""
        inside = ~SPACE[self.data]
        n = len(inside)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        s = np.flatnonzero(begins)
        return s, np.flatnonzero(ends) + 1, np.searchsorted(s, self.at)


def slabs(column: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """The texts of a string column, whole, in slabs of about ``limit`` bytes."""
    if len(column) == 0:
        return
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield Slab(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    m, done = x, 1
    while 2 * done <= width:
        m, done = np.minimum(m[:-done], m[done:]), 2 * done
    return np.minimum(m[:len(m) - (width - done)], m[width - done:]) if width > done else m


def anchors(order: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, least): positions that are least in a valid run of ``width`` values (all of them at a
    tie), and each run's least value; ``valid`` says which runs count, one flag per run start.

    Equal content gives equal choices at equal places, and every run holds one: what two long
    passages share can be found from these positions alone.
    """
    if len(order) < width:
        return np.zeros(0, np.int64), order[:0]
    least = window_min(order, width)
    # a position is chosen if it reaches the largest minimum of the valid runs around it
    pad = np.zeros(width - 1, order.dtype)
    top = ~window_min(~np.concatenate([pad, np.where(valid, least, 0), pad]), width)
    return np.flatnonzero(order <= top), least


def run_starts(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags, for the starts 0..n-width, of runs of ``width`` items that lie within one text."""
    flags = np.zeros(max(0, n - width + 1) + 1, np.int32)
    first, last = bounds[:-1], bounds[1:] - width + 1
    some = last > first
    np.add.at(flags, first[some], 1)
    np.add.at(flags, last[some], -1)
    return np.cumsum(flags[:-1]) > 0
