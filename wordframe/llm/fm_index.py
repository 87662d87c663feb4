"""FM-index over sequences of small integers: suffix array, wavelet matrix of the BWT, sampled positions."""
import numpy as np

SAMPLE = 8      # every SAMPLE-th text position is kept for locating


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the sorted length until all ranks differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = new
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        step *= 2


class BitRank:
    """Bits with constant-time counts of the ones before a position."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[:self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1]
        self.total = int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Rank and access of symbols, one level of bits after another from the highest."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            high = (symbols >> b) & 1 == 1
            self.levels.append(BitRank(high))
            symbols = np.concatenate([symbols[~high], symbols[high]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at
        for depth, level in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - depth)) & 1 == 1
            a, z, zeros = level.ones(low), level.ones(high), level.n - level.total
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + z, high - z)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at positions, and how often each stands before its position."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for level in self.levels:
            one, zeros = level.get(at), level.n - level.total
            a, z = level.ones(low), level.ones(at)
            low = np.where(one, zeros + a, low - a)
            at = np.where(one, zeros + z, at - z)
            symbol = symbol * 2 + one
        return symbol, at - low


class FMIndex:
    """Counts and places of patterns in ``symbols`` (integers from 1 on; 0 is the end mark)."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(np.asarray(symbols, np.int64), 0)
        self.n = len(text)
        order = suffix_array(text)
        self.top = int(text.max(initial=0))
        self.before = np.searchsorted(text[order], np.arange(self.top + 2))
        self.wavelet = WaveletMatrix(text[order - 1], max(1, self.top.bit_length()))
        kept = order % sample == 0
        self.sampled, self.places = BitRank(kept), order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the rows of ``patterns``; row i counts its first ``lengths[i]`` symbols."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        low[lengths == 0] = high[lengths == 0] = 0
        for k in range(int(lengths.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero((lengths > k) & (low < high))
            symbol = patterns[live, k]
            known = (symbol >= 1) & (symbol <= self.top)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of the suffixes in the ranges, each with the number of its range."""
        sizes = np.maximum(high - low, 0)
        owner = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner]
        place, steps = np.full(len(at), -1), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            there = self.sampled.get(at[live])
            done = live[there]
            place[done] = self.places[self.sampled.ones(at[done])] + steps[done]
            live = live[~there]
            symbol, count = self.wavelet.access(at[live])
            at[live] = self.before[symbol] + count
            steps[live] += 1
        return place, owner
