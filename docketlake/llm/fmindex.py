"""FM-index over word sequences: suffix order, Burrows-Wheeler transform, wavelet matrix.

Built and searched in numpy, many patterns at a time. The bit vectors are packed, with a running
count per 64-bit word, so rank is one lookup and one population count. Suffixes are ordered by
their first words up to the threshold, which is all that matching statistics capped there need. The
bounds of suffixes that agree on d words are one more bit vector for each d (two bits a position with
its counts), read by rank and select; no list of positions is kept.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank and select."""

    def __init__(self, bit: np.ndarray):
        self.words = np.packbits(np.pad(bit.astype(np.uint8), (0, -len(bit) % 64 + 64)), bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & mask)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one, counted from 0; it must exist."""
        word = np.searchsorted(self.counts, k, "right") - 1
        left = (k - self.counts[word]).astype(np.uint64)
        rest, at = self.words[word], np.zeros(len(k), np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(rest & np.uint64((1 << half) - 1)).astype(np.uint64)
            above = left >= low
            left = np.where(above, left - low, left)
            rest = np.where(above, rest >> np.uint64(half), rest)
            at += np.where(above, np.uint64(half), np.uint64(0))
        return word * 64 + at.astype(np.int64)


class WaveletMatrix:
    """Rank queries over a sequence of symbols below ``sigma``."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.bits, self.zeros = [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = self.bits[level].rank(i)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        return self._walk(symbol, i) - self.base[symbol]


class FMIndex:
    """Of several word sequences (64-bit words), each with an owner; the least owner of a match is reported."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, depth: int):
        self.depth = depth
        words = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.words, coded = np.unique(words, return_inverse=True)
        sigma = len(self.words) + 1
        n = len(words) + len(sizes)
        text = np.zeros(n, np.int64)  # 0 ends a sequence
        place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text[place] = coded + 1
        owner = np.repeat(np.asarray(owners, np.int64), sizes + 1)
        rank, width = text, 1
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[:-width] = rank[width:] if width < n else 0
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + ahead, return_inverse=True)[1] if n else rank
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.matrix = WaveletMatrix(text[order - 1] if n else text, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        common = np.zeros(n, np.int64)  # words shared with the suffix before, up to depth
        alive = np.ones(n, bool)
        alive[:1] = False
        for j in range(depth):
            at = order + j
            ok = (at[1:] < n) & (at[:-1] < n)
            same = np.zeros(n, bool)
            a, b = text[np.minimum(at[1:], n - 1)], text[np.minimum(at[:-1], n - 1)]
            same[1:] = ok & (a == b) & (a > 0)
            alive &= same
            common += alive
        self.n = n
        self.heads = [Bits(np.append(common < d, True)) for d in range(1, depth)]  # a one where suffixes stop agreeing on d words
        head = np.flatnonzero(common < depth)
        self.full = Bits(np.append(common < depth, True))
        self.least = np.minimum.reduceat(owner[order], head) if n else owner  # of each group that agrees on depth words

    def matching(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of concatenated sequences, capped at depth, and the least owner of each full match.

        One word of every sequence is taken per step, from the right: the interval of the match to
        the right is cut to depth - 1 words, then extended by backward search; where that fails, it
        is cut further until it works. Without a full match the owner is -1.
        """
        sizes = np.array([len(s) for s in sequences], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        statistic, owner = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        if not self.n or not len(words):
            return statistic, owner
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        code = np.where(self.words[at] == words, at + 1, 0)
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        length = np.zeros(len(sizes), np.int64)
        for step in range(int(sizes.max())):
            lanes = np.flatnonzero(sizes > step)
            spot = starts[lanes + 1] - 1 - step
            self._cut(lanes, low, high, length, np.minimum(length[lanes], self.depth - 1))
            todo, symbol = lanes, code[spot]
            strange = symbol == 0
            low[todo[strange]], high[todo[strange]], length[todo[strange]] = 0, self.n, 0
            todo, symbol = todo[~strange], symbol[~strange]
            while len(todo):
                a = self.first[symbol] + self.matrix.rank(symbol, low[todo])
                b = self.first[symbol] + self.matrix.rank(symbol, high[todo])
                good = b > a
                won = todo[good]
                low[won], high[won] = a[good], b[good]
                length[won] += 1
                todo, symbol = todo[~good], symbol[~good]
                self._cut(todo, low, high, length, length[todo] - 1)
            statistic[spot] = length[lanes]
            full = length[lanes] == self.depth
            owner[spot[full]] = self.least[self.full.rank(low[lanes[full]] + 1) - 1]
        return statistic, owner

    def _cut(self, lanes: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray, to: np.ndarray) -> None:
        shorter = to < length[lanes]
        lanes, to = lanes[shorter], to[shorter]
        for d in np.unique(to):
            pick = lanes[to == d]
            if d == 0:
                low[pick], high[pick] = 0, self.n
                continue
            group = self.heads[d - 1].rank(low[pick] + 1)
            low[pick], high[pick] = self.heads[d - 1].select(group - 1), self.heads[d - 1].select(group)
        length[lanes] = to
