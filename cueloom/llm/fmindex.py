"""An FM-index over a sequence of whole numbers: suffix array, wavelet-matrix ranks, sampled positions; all in numpy, many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts all suffixes by prefix doubling; each round sorts only the suffixes whose place is still open."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    sa = np.argsort(text, kind="stable")
    key = text[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[sa] = head  # the place of the first suffix of its group
    step = 1
    while True:
        size = np.bincount(head, minlength=n)
        open_ = np.flatnonzero(size[head] > 1)
        if not len(open_):
            return sa
        at = sa[open_]
        nxt = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        order = np.lexsort((nxt, head[open_]))
        at, h, nxt = at[order], head[open_][order], nxt[order]
        sa[open_] = at
        split = np.r_[True, (h[1:] != h[:-1]) | (nxt[1:] != nxt[:-1])]
        head[open_] = open_[np.flatnonzero(split)[np.cumsum(split) - 1]]
        rank[at] = head[open_]
        step *= 2


class WaveletMatrix:
    """rank(symbol, i): how often symbol occurs before i, for arrays of both at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        v = values
        for k in range(self.levels - 1, -1, -1):
            bit = (v >> k) & 1
            ones = np.zeros(len(v) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(v) - int(ones[-1]))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(i), np.int64)
        end = i.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.levels - 1 - level)) & 1
            ob, oe = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin = np.where(bit == 1, zeros + ob, begin - ob)
            end = np.where(bit == 1, zeros + oe, end - oe)
        return end - begin

    def access(self, i: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(i), np.int64), i.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            o = ones[at].astype(np.int64)
            bit = ones[at + 1].astype(np.int64) - o
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + o, at - o)
        return out


class FMIndex:
    """Symbols are from 0 to symbols - 1; 0 is for separators, and a last one is added to end the text."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        text = np.append(text.astype(np.int64), 0)
        # The end is smaller than any other separator, and so comes first.
        shifted = text + 1
        shifted[-1] = 0
        sa = suffix_array(shifted)
        self.n = len(text)
        bwt = shifted[sa - 1]
        self.matrix = WaveletMatrix(bwt, symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=symbols + 1))]).astype(np.int64)
        self.marked = sa % sample == 0
        self.marks = np.concatenate([[0], np.cumsum(self.marked)]).astype(np.int64)
        self.samples = sa[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern; patterns: rows padded on the right."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                continue
            c = patterns[live, lengths[live] - back] + 1
            lo[live] = self.before[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.before[c] + self.matrix.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps backwards to the next sampled one."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.marks[at[done]]] + steps[done]
            todo = todo[~hit]
            if len(todo):
                c = self.matrix.access(at[todo])
                at[todo] = self.before[c] + self.matrix.rank(c, at[todo])
                steps[todo] += 1
        return out
