"""Vectorised word work on Arrow string columns: word bounds, hashes and grouped counts in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time (a longer text goes alone).
PIECE = 1 << 21
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of letters: ASCII letters and every byte of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) over consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + PIECE, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Words:
    """Words of a piece: start, end (bytes), doc (row in the piece), hash; bounds[d]:bounds[d+1] are those of row d."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None):
        on = ~SPACE[data] if inside is None else inside[data]
        first = on.copy()
        first[1:] &= ~on[:-1]
        cut = offs[:-1][offs[:-1] < len(data)]  # a row's first byte starts a word of its own
        first[cut] = on[cut]
        self.start = np.flatnonzero(first)
        last = on.copy()
        last[:-1] &= ~on[1:] | first[1:]
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self.count = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        size = self.end - self.start
        if len(size):
            at = np.flatnonzero(on)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            power = np.ones(int(size.max()), np.uint64)
            with np.errstate(over="ignore"):
                power[1:] = np.multiply.accumulate(np.full(len(power) - 1, BASE))
                value = _BYTE[_LOWER[data[at]]] * power[pos]
                self.first = np.cumsum(size) - size
                self.hash = mix(np.add.reduceat(value, self.first))
            self.value = value
        else:
            self.hash = self.value = np.zeros(0, np.uint64)
            self.first = np.zeros(0, np.int64)

    def beginnings(self, lengths: tuple[int, ...]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each length in bytes: the words that are longer, and the hash of their first bytes."""
        out = {}
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value, dtype=np.uint64)])
            for k in lengths:
                which = np.flatnonzero(self.end - self.start > k)
                out[k] = which, total[self.first[which] + k] - total[self.first[which]]
        return out

    def shingles(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of every k consecutive words of a row; with `short`, fewer words make one shingle."""
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.uint64)
            for j in range(min(k, n)):
                out[: n - j] = out[: n - j] * BASE + self.hash[j:]
            ok = np.zeros(n, bool)
            if n >= k:
                ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
            doc, got = self.doc[ok], mix(out[ok] + np.uint64(k))
            if short:
                rows = np.flatnonzero((self.count > 0) & (self.count < k))
                whole = np.zeros(len(rows), np.uint64)
                for j in range(k - 1):
                    more = self.count[rows] > j
                    whole[more] = whole[more] * BASE + self.hash[self.bounds[rows[more]] + j]
                whole = mix(whole + self.count[rows].astype(np.uint64))
                doc, got = np.concatenate([doc, rows]), np.concatenate([got, whole])
        return doc, got


def runs(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows: distinct values, and the uses of the most frequent one."""
    distinct, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(doc):
        key = np.sort(doc.astype(np.uint64) << np.uint64(43) | value >> np.uint64(21))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own = (key[at] >> np.uint64(43)).astype(np.int64)
        distinct = np.bincount(own, minlength=n)
        rows = np.flatnonzero(distinct)
        top[rows] = np.maximum.reduceat(np.diff(np.append(at, len(key))), np.searchsorted(own, rows))
    return distinct, top
