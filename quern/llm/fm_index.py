"""A compressed FM-index over word sequences: a wavelet matrix on the Burrows-Wheeler transform.

What is kept of the suffix order are packed bit vectors with rank and select, the symbols'
counts and one owner per distinct window; the order itself is thrown away. All queries run on
arrays, many patterns side by side.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank and select."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = i >> 6
        below = self.words[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that ``k`` ones come before."""
        at = np.searchsorted(self.before, k, side="right") - 1
        rest, word, place = k - self.before[at], self.words[at], at << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            upper = rest >= low
            rest = np.where(upper, rest - low, rest)
            word = np.where(upper, word >> np.uint64(half), word)
            place = np.where(upper, place + half, place)
        return place

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletMatrix:
    """Rank of any symbol in a sequence, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(size)
        self.first = self._walk(every, np.zeros(size, np.int64)).astype(np.int32)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self.first[symbol]

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + sum(bits.nbytes for bits, _ in self.levels)


def _agreeing(kept: dict[int, np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """Whether neighbours in suffix order share their first words, by ranks of the pieces whose lengths add up to the window."""
    n = len(suffixes)
    same = np.ones(max(n - 1, 0), bool)
    a, b, at = suffixes[:-1], suffixes[1:], 0
    for span in sorted(kept, reverse=True):
        x, y = a + at, b + at
        inside = (x < n) & (y < n)
        same &= inside
        same[inside] &= kept[span][x[inside]] == kept[span][y[inside]]
        at += span
    return same


class FmIndex:
    """The index of several word sequences, each with an owner, for matches of ``window`` words.

    ``sequences`` holds word numbers from 0; every sequence ends in a separator of its own, so
    no match runs over two.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        m = len(sequences)
        starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])[:-1]
        lengths = np.array([len(s) for s in sequences])
        n = int(lengths.sum()) + m
        text = np.zeros(n, np.int64)  # 0: a separator; words from 1
        word = np.ones(n, bool)
        word[starts + lengths] = False
        text[word] = np.concatenate(sequences) + 1
        self.n, self.window, self.size = n, window, int(text.max(initial=0)) + 1
        # prefix doubling; each separator is a symbol of its own, below all words
        rank = np.where(word, text + m, 0)
        rank[~word] = np.arange(m)
        _, rank = np.unique(rank, return_inverse=True)
        kept, span, apart = {}, 1, False
        while not apart or span <= window:
            if span & window:
                kept[span] = rank
            if not apart:
                ahead = np.zeros(n, np.int64)
                ahead[: max(n - span, 0)] = rank[span:] + 1
                key = rank * (n + 1) + ahead
                order = np.argsort(key)
                key = key[order]
                new = np.cumsum(np.r_[False, key[1:] != key[:-1]])
                rank = np.empty(n, np.int64)
                rank[order] = new
                apart = bool(new[-1] == n - 1)
            span *= 2
        # a block: the suffixes that share their first words, ``window`` of them
        fresh = np.r_[True, ~_agreeing(kept, order)]
        self.blocks = Bits(np.r_[fresh, True])  # one more ends the last block
        names, code = np.unique(owners, return_inverse=True)
        owner = code[np.searchsorted(starts, order, side="right") - 1]
        self.names, self.first = names, np.minimum.reduceat(owner, np.flatnonzero(fresh)).astype(np.min_scalar_type(len(names)))
        counts = np.bincount(text, minlength=self.size)
        self.less = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int32)
        self.wavelet = WaveletMatrix(text[order - 1], self.size)  # the text is read as a ring

    @property
    def nbytes(self) -> int:
        return self.wavelet.nbytes + self.blocks.nbytes + self.first.nbytes + self.less.nbytes + self.names.nbytes

    def step(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns grown by a word number on the left."""
        base = self.less[word + 1]
        return base + self.wavelet.rank(word + 1, lo), base + self.wavelet.rank(word + 1, hi)

    def first_owners(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each pattern the least owner of a sequence that has it, as a place in ``names``; -1 where none does.

        Patterns are any word sequences; words that the index does not know are negative. Each
        is streamed from right to left, and what is held are its matching statistics cut at
        ``window``: the interval of suffixes that begin with the words from here to the end of the
        match. A step that leaves none drops the match's last word and searches what is left
        anew. At ``window`` words the interval's block tells the owner, and the interval is widened to
        the block, so that the next word costs one step.
        """
        window, lengths = self.window, np.array([len(p) for p in patterns], np.int64)
        flat = np.concatenate(patterns) if len(patterns) else np.zeros(0, np.int64)
        flat = np.where(flat < self.size - 1, flat, -1)
        base = np.cumsum(lengths) - lengths
        found = np.full(len(flat), -1, np.int64)
        at = base[lengths >= window]  # where each pattern starts; the match runs from place to end
        place = end = (base + lengths)[lengths >= window]
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        while len(at):
            word = flat[place - 1]
            low, high = self.step(lo, hi, np.maximum(word, 0))
            grown = (word >= 0) & (low < high)
            # a word that matches nothing is passed over, a longer match loses its last word
            end = np.where(grown, np.minimum(end, place - 1 + window), end - 1)
            place = np.where(grown, place - 1, end)
            lo, hi = np.where(grown, low, 0), np.where(grown, high, self.n)
            whole = np.flatnonzero(grown & (end - place == window))
            if len(whole):
                block = self.blocks.rank(lo[whole] + 1) - 1
                found[place[whole]] = self.first[block]
                lo[whole], hi[whole] = self.blocks.select(block), self.blocks.select(block + 1)
            live = (place > at) & (end - at >= window)
            if not live.all():
                at, place, end, lo, hi = (x[live] for x in (at, place, end, lo, hi))
        return [found[b : b + max(0, n - window + 1)] for b, n in zip(base.tolist(), lengths.tolist())]
