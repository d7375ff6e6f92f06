"""FM-index over integer symbols: suffix order, Burrows-Wheeler text, wavelet ranks, sampled positions.

Symbol 0 is a break: no pattern crosses it, and breaks are ordered by position.
All searches take many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Suffixes in order; ``text`` ends with 0, symbols are 0..top.

    A suffix whose packed first symbols reach a break is settled by the stable
    sort (breaks order by position); the others double their compared length
    until all are apart.
    """
    n = len(text)
    bits = max(1, int(top).bit_length())
    width = min(max(1, 62 // bits), 8)
    key = np.zeros(n, dtype=np.int64)
    live = np.ones(n, dtype=bool)
    for j in range(width):
        part = np.zeros(n, dtype=np.int64)
        part[:max(0, n - j)] = text[j:]
        part[~live] = 0
        key = (key << bits) | part
        live &= part > 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~live[order[1:]]
    del key, sorted_key
    rank = np.empty(n, dtype=np.int64)
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    places = np.flatnonzero(tied)
    reach = width
    while len(places):
        some = order[places]
        second = rank[np.minimum(some + reach, n - 1)]
        first = rank[some]
        by = np.lexsort((second, first))
        some, first, second = some[by], first[by], second[by]
        order[places] = some
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[some] = np.maximum.accumulate(np.where(fresh, places, 0))
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        places = places[tied]
        reach *= 2
    return order


class WaveletRanks:
    """Occurrences of a symbol before a position, one bit vector with block counts per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        n = len(symbols)
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - n % 64, bool))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(n - int(self.counts[-1][-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        self.first = self._descend(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            ones = self._ones(k, at)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for k in range(self.levels):
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(k, at)
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol


class FMIndex:
    """Index of ``text`` (symbols 0..top, last one 0), every ``sample``-th position and each after a break sampled."""

    def __init__(self, text: np.ndarray, top: int, sample: int = 16):
        order = suffix_order(text, top)
        before = text[order - 1]
        before[order == 0] = 0
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.bwt = WaveletRanks(before, top)
        self.n = len(text)
        kept = (order % sample == 0) | (before == 0)
        self.kept = np.packbits(np.concatenate((kept, np.zeros(64 - self.n % 64, bool))), bitorder="little").view(np.uint64)
        self.kept_counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64)))
        self.samples = order[kept]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each pattern (rows of a matrix, ``lengths`` symbols from the left)."""
        count = len(patterns)
        low, high = np.zeros(count, dtype=np.int64), np.full(count, self.n, dtype=np.int64)
        live = np.arange(count)
        for step in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > step]
            symbol = patterns[live, lengths[live] - 1 - step]
            low[live] = self.less[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back until a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        who, steps = np.arange(len(rows)), 0
        while len(rows):
            word, bit = rows >> 6, (rows & 63).astype(np.uint64)
            found = (self.kept[word] >> bit & np.uint64(1)).astype(bool)
            hit, hit_bit = word[found], bit[found]
            mask = (np.uint64(1) << hit_bit) - np.uint64(1)
            out[who[found]] = self.samples[self.kept_counts[hit] + np.bitwise_count(self.kept[hit] & mask)] + steps
            rows, who = rows[~found], who[~found]
            symbol = self.bwt.access(rows)
            rows = self.less[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out
