"""Compressed full-text index over numbered words: backward search on a wavelet tree, in numpy."""

from __future__ import annotations

import numpy as np

#: Suffixes are ordered by their first DEPTH symbols, enough for patterns of that length.
DEPTH = 16
#: Patterns searched at once, so that the arrays of a step stay in cache.
_LANES = 1 << 15


class WaveletTree:
    """Rank of any symbol in a sequence, one packed bit vector per level (levels laid out as a matrix)."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.size, self.levels = len(values), max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        values = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.uint32)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(ones[:-1])]).astype(np.int64))
            self.zeros.append(self.size - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        every = np.arange(symbols, dtype=np.int64)
        self.origin = self._walk(every, np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word, below = place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below)
            right = (symbol >> (self.levels - 1 - k)) & 1
            place = np.where(right == 1, self.zeros[k] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self.origin[symbol]


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their next ``depth`` symbols, by doubling; ties keep the order of the text."""
    n = len(text)
    rank, width = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        width *= 2
    return order


class FMIndex:
    """Index of a text of symbols 1..symbols-1, parts ended by 0."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int = DEPTH):
        self.depth = depth
        self.places = _suffixes(text, depth)
        self.tree = WaveletTree(text[self.places - 1], symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def matches(self, patterns: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics up to ``length`` of the pattern text at each exclusive end.

        Returns the longest match that ends there (never across a 0) and its range of suffixes.
        """
        if length > self.depth:
            raise ValueError(f"matches are at most {self.depth} symbols long")
        found = [self._search(patterns, ends[k:k + _LANES], length) for k in range(0, len(ends), _LANES)]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, zip(*found)))

    def _search(self, patterns: np.ndarray, ends: np.ndarray, length: int):
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.places), np.int64)
        size, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(1, length + 1):
            live = live[ends[live] >= step]
            symbol = patterns[ends[live] - step]
            live, symbol = live[symbol != 0], symbol[symbol != 0]
            if not len(live):
                break
            if step == 1:
                low, high = self.starts[symbol], self.starts[symbol + 1]
            else:
                both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
                low, high = self.starts[symbol] + both[: len(live)], self.starts[symbol] + both[len(live):]
            some = low < high
            live = live[some]
            lo[live], hi[live], size[live] = low[some], high[some], step
        return size, lo, hi


def range_minimum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest value of each range; every distinct range is read once."""
    pairs, back = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
    padded = np.append(values, np.iinfo(values.dtype).max)
    return np.minimum.reduceat(padded, pairs.ravel())[::2][back.ravel()]
