"""An FM-index over integer sequences: wavelet matrix of the Burrows-Wheeler transform, backward search in numpy.

Sequences are joined with a separator symbol. Suffixes are sorted to a depth of DEPTH symbols, so patterns of up to DEPTH
symbols are found exactly. Bit vectors are packed 64 to a word with a running count for each word.
"""

from __future__ import annotations

import numpy as np

DEPTH = 128


class FMIndex:
    def __init__(self, symbols: np.ndarray, owner: np.ndarray):
        """symbols: 0 is the separator and ends each sequence; owner: what each place belongs to (smaller is earlier)."""
        n = self.n = len(symbols)
        self.sigma = int(symbols.max()) + 1 if n else 1
        order = self.suffixes(symbols)
        last = symbols[order - 1]  # the symbol before each suffix, cyclically
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=self.sigma))].astype(np.int64)
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        start = np.zeros(self.sigma, np.int64)
        x = last
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            packed = np.packbits(np.r_[bit, np.zeros(-n % 64 + 64, bit.dtype)].astype(np.uint8), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed).astype(np.int64))[:-1]])
            self.zeros.append(int(n - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.base = start
        self.base = self.rank(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        # smallest owner in any range of suffixes: a table of ranges of power-of-two length
        low = owner[order]
        self.low = [low]
        width = 1
        while 2 * width <= n:
            prev = self.low[-1]
            self.low.append(np.minimum(prev[: n - 2 * width + 1], prev[width : width + n - 2 * width + 1]))
            width *= 2

    @staticmethod
    def suffixes(symbols: np.ndarray) -> np.ndarray:
        """The order of all cyclic suffixes by their first DEPTH symbols, by prefix doubling."""
        n, depth = len(symbols), 1
        rank = symbols.astype(np.int64)
        while True:
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -depth)
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            depth *= 2
            if depth >= DEPTH or (n and rank[order[-1]] == n - 1):
                return order

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place in the transform."""
        at = place
        for k in range(self.levels):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at - self.base[symbol]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The suffix ranges after putting the symbol before the patterns found so far."""
        both = self.rank(np.r_[symbol, symbol], np.r_[lo, hi]) + np.r_[self.first[symbol], self.first[symbol]]
        return both[: len(lo)], both[len(lo) :]

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in each range lo <= place < hi; ranges are not empty."""
        out = np.empty(len(lo), self.low[0].dtype)
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for p in np.unique(power):
            m = power == p
            row = self.low[p]
            out[m] = np.minimum(row[lo[m]], row[hi[m] - (1 << int(p))])
        return out


def matched_windows(index: FMIndex, symbols: np.ndarray, begin: np.ndarray, windows: np.ndarray, own: np.ndarray, width: int) -> np.ndarray:
    """Which windows of the streamed segments also stand in a sequence of an earlier owner.

    Segment k has windows[k] windows of ``width`` symbols, the first at symbols[begin[k]]; the result is flat, segment
    after segment. All segments are searched at once, each from the right end of a stretch of windows to its left: a
    stretch that is found whole settles all its windows; one that fails is tried again at half the length; a single
    window that fails at some place rules out all windows that cover what was not found (matching statistics with
    the skip of Boyer and Moore)."""
    out_at = np.r_[0, np.cumsum(windows)]
    hit = np.zeros(int(out_at[-1]), bool)
    live = np.flatnonzero(windows > 0)
    s = np.zeros(len(windows), np.int64)
    d = windows.astype(np.int64).copy()
    j = s + d + width - 1
    lo = np.zeros(len(windows), np.int64)
    hi = np.full(len(windows), index.n, np.int64)
    while len(live):
        j[live] -= 1
        a, z = index.step(symbols[begin[live] + j[live]], lo[live], hi[live])
        lo[live], hi[live] = a, z
        ok = a < z
        some = np.flatnonzero(ok)
        ok[some] = index.earliest(a[some], z[some]) < own[live[some]]
        done = live[ok & (j[live] == s[live])]
        for k in done.tolist():
            hit[out_at[k] + s[k] : out_at[k] + s[k] + d[k]] = True
        s[done] += d[done]
        d[done] = 2 * d[done]
        lost = live[~ok]
        single = lost[d[lost] == 1]
        s[single] = j[single] + 1
        longer = lost[d[lost] > 1]
        # a stretch whose right part failed before its last window began tells nothing of shorter ones
        d[longer] = np.maximum(1, d[longer] // 2)
        again = np.concatenate([done, lost])
        d[again] = np.minimum(d[again], windows[again] - s[again])
        j[again] = s[again] + d[again] + width - 1
        lo[again], hi[again] = 0, index.n
        live = live[s[live] < windows[live]]
    return hit
