"""A compressed FM-index over sequences of words, with backward search for many patterns at once."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into 64-bit words, with the ones before each word counted."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def previous(self, i: np.ndarray) -> np.ndarray:
        """The last one at each position or before it; there must be one."""
        word = i >> 6
        bits = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (i & 63).astype(np.uint64)))
        while (empty := bits == 0).any():
            word = word - empty
            bits = np.where(empty, self.words[word], bits)
        high = bits >> np.uint64(32)
        half = np.where(high > 0, high, bits & np.uint64(0xFFFFFFFF)).astype(float)
        return (word << 6) + np.where(high > 0, 31, -1) + np.frexp(half)[1]

    def following(self, i: np.ndarray) -> np.ndarray:
        """The first one at each position or after it; there must be one."""
        word = i >> 6
        bits = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (i & 63).astype(np.uint64))
        while (empty := bits == 0).any():
            word = word + empty
            bits = np.where(empty, self.words[word], bits)
        lowest = bits & (~bits + np.uint64(1))
        return (word << 6) + np.bitwise_count(lowest - np.uint64(1))


class WaveletTree:
    """The symbols of a sequence, a bit vector for each bit of a symbol; nodes of a level stand side by side."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        first = np.arange(sigma)
        start = np.zeros(sigma, np.int64)
        for level in reversed(range(self.levels)):
            one = (symbols >> level) & 1 == 1
            self.bits.append(BitVector(one))
            self.zeros.append(int(len(one) - one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])
            start = self._down(len(self.bits) - 1, (first >> level) & 1 == 1, start)
        self.start = start  # where a symbol's occurrences begin below the last level

    def _down(self, k: int, one: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = self.bits[k].rank(i)
        return np.where(one, self.zeros[k] + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start = self.start[symbol]
        for k, level in enumerate(reversed(range(self.levels))):
            i = self._down(k, (symbol >> level) & 1 == 1, i)
        return i - start


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """A compressed index of a sequence of symbols 0 to sigma - 1 that finds patterns of up to depth + 1 symbols.

    It keeps the wavelet tree of the Burrows-Wheeler transform, the symbols' counts, and a bit for each row: whether it
    differs from the row before in the first depth symbols. The order of the suffixes is used to build it and let go.
    Suffixes are sorted by their first 32 symbols, more than any such pattern has, so that the rows of a pattern
    are next to one another. A symbol less than all others ends the text, so there is a row more than symbols.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        if not 16 < depth < 31:
            raise ValueError("depth must lie between 17 and 30")
        text, sigma = np.append(text.astype(np.int64) + 1, 0), sigma + 1
        n = len(text)
        by_length = {1: text}
        for length in (1, 2, 4, 8, 16):
            rank = by_length[length]
            by_length[2 * length] = _ranks(rank * (n + sigma + 1) + self._shifted(rank, length))
        suffixes = np.argsort(by_length[32], kind="stable")
        rest, more = depth - 16, np.zeros(n, np.int64)
        at = 16
        for length in (8, 4, 2, 1):
            if rest & length:
                more = _ranks(more * (n + sigma + 1) + self._shifted(by_length[length], at))
                at += length
        first, second = by_length[16][suffixes], more[suffixes]
        new = np.ones(n + 1, bool)  # the end of the rows counts as a difference
        new[1:-1] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.new = BitVector(new)
        self.tree = WaveletTree(text[suffixes - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]]).astype(np.int64)
        self.depth, self.size = depth, n

    @staticmethod
    def _shifted(values: np.ndarray, by: int) -> np.ndarray:
        """The value so many places on, plus 1; 0 past the end."""
        out = np.zeros(len(values), np.int64)
        out[: len(values) - by] = values[by:] + 1 if by < len(values) else 0
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of symbol + pattern from the rows [low, high) of the pattern."""
        symbol = symbol + 1
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.smaller[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that agree in depth symbols with those from low to high, which agree in more."""
        return self.new.previous(low), self.new.following(high)


def matches(index: FMIndex, patterns: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics, cut at index.depth, of documents patterns[start:end], each read from its end.

    Returns for each position the length of the longest match that begins there (depth at most) and its rows, from
    and to. Symbols unknown to the index are -1; there, and wherever a match can't be extended, the match begins anew.
    """
    length, first, last = (np.zeros(len(patterns), np.int64) for _ in range(3))
    lane = np.flatnonzero(ends > starts)
    at = ends[lane] - 1
    low, high, m = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        symbol = patterns[at]
        a, b = index.extend(np.maximum(symbol, 0), low, high)
        lost = (a >= b) | (symbol < 0)
        if lost.any():  # a shorter match from the same end: the pattern is looked for anew, word by word
            for k in np.flatnonzero(lost):
                a[k], b[k], m[k] = _anew(index, patterns, at[k], min(ends[lane[k]], at[k] + index.depth))
        m = np.where(lost, m, m + 1)
        over = m > index.depth
        if over.any():
            a[over], b[over] = index.shorten(a[over], b[over])
            m[over] = index.depth
        length[at], first[at], last[at] = m, a, b
        low, high = a, b
        go = at > starts[lane]
        lane, at, low, high, m = lane[go], at[go] - 1, low[go], high[go], m[go]
    return length, first, last


def _anew(index: FMIndex, patterns: np.ndarray, at: int, end: int) -> tuple[int, int, int]:
    """Rows and length of the longest prefix of patterns[at:end] that the index has."""
    best = (0, index.size, 0)
    for stop in range(at + 1, end + 1):
        low, high = np.array([0]), np.array([index.size])
        for k in range(stop - 1, at - 1, -1):
            if patterns[k] < 0:
                return best
            low, high = index.extend(patterns[k : k + 1], low, high)
        if low[0] >= high[0]:
            return best
        best = (int(low[0]), int(high[0]), stop - at)
    return best
