"""Vectorised word handling for Arrow batches of texts: cutting, hashing, windows and heavy-hitter counts.

Everything works on bounded pieces of a batch, so that a task holds a few megabytes of text (or one text, if longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Words:
    """Words of several texts: ``data`` holds them joined by single blanks, ``first[i] : first[i + 1]`` are those of text i."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lower: bool = False):
        """raw: bytes of all texts, with at least one blank after each; bounds: where texts begin, and the end."""
        blank = _BLANK[raw]
        ended = np.empty_like(blank)  # keep the first blank after each word
        ended[:1] = False
        ended[1:] = ~blank[:-1]
        keep = ~blank | ended
        data = raw[keep]
        gap = blank[keep]
        data[gap] = 0x20
        self.data = _LOWER[data] if lower else data
        self.ends = np.flatnonzero(gap)
        self.starts = np.empty_like(self.ends)
        self.starts[:1] = 0
        self.starts[1:] = self.ends[:-1] + 1
        kept = np.add.reduceat(keep, bounds[:-1], dtype=np.int64) if len(bounds) > 1 else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(kept))))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word. Works on a megabyte at a time: the sums take eight times the bytes."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            begin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, begin + PIECE_BYTES, "right")))
            data = self.data[begin : self.ends[to - 1]]
            up, down = _power_tables(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
            first = self.starts[at:to] - begin
            out[at:to] = mix64((total[self.ends[at:to] - begin] - total[first]) * down[first])
            at = to
        return out

    def owners(self) -> np.ndarray:
        """Which text each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, over all texts together."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = (total + words[j : j + n]) * np.uint64(_BASE)
    return mix64(total)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts up to ``limit`` bytes; null texts are empty."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    if texts.null_count:
        sizes = np.where(np.asarray(texts.is_valid()), sizes, 0)
    row = 0
    while row < n:
        end = row + max(1, int(np.searchsorted(np.cumsum(sizes[row:] + 1), limit, "right")))
        took = sizes[row:end] + 1
        bounds = np.concatenate(([0], np.cumsum(took)))
        out = np.full(int(bounds[-1]), 0x20, np.uint8)
        for i in range(row, end):
            b = bounds[i - row]
            out[b : b + sizes[i]] = raw[at[i] : at[i] + sizes[i]]
        yield row, end, out, bounds
        row = end


class Frequent:
    """Lossy counts of hashes: what is rare in every run of ``gather`` hashes is left out, what is frequent is never missed by much."""

    def __init__(self, least: int = 2, keep: int = 50_000, gather: int = 0):
        self.least, self.keep, self.gather = least, keep, gather
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n_waiting += len(hashes)
        if self.n_waiting > self.gather:
            self._count()

    def _count(self) -> None:
        values, n = np.unique(np.concatenate(self.waiting or [self.values[:0]]), return_counts=True)
        often = n >= self.least
        merged, place = np.unique(np.concatenate((self.values, values[often])), return_inverse=True)
        self.counts = np.bincount(place, np.concatenate((self.counts, n[often])), len(merged)).astype(np.int64)
        self.values, self.waiting, self.n_waiting = merged, [], 0
        if len(merged) > 4 * self.keep:
            self._trim()

    def _trim(self) -> None:
        if len(self.values) > self.keep:
            top = np.sort(np.argpartition(-self.counts, self.keep - 1)[: self.keep])
            self.values, self.counts = self.values[top], self.counts[top]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        self._trim()
        return self.values, self.counts


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
