"""A compressed FM-index over a sequence of symbols: wavelet matrix on the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of small integers, one packed bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.words: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        self.zeros: list[int] = []
        rest = symbols
        for bit in range(bits - 1, -1, -1):
            ones = (rest >> bit & 1).astype(bool)
            padded = np.zeros((len(rest) // 64 + 1) * 64, bool)
            padded[: len(rest)] = ones
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.blocks.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(len(rest) - int(ones.sum()))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbols: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each symbol: its occurrences before ``places``. ``starts`` is where each symbol's
        own run begins after the last level, which turns the place reached there into a count."""
        at = places
        for level in range(self.bits):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[level][word] + np.bitwise_count(self.words[level][word] & mask)
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            at = np.where(one, ones + self.zeros[level], at - ones)
        return at - starts[symbols]


class FmIndex:
    """Backward search for patterns of at most ``depth`` symbols.

    Suffixes are ordered by their first ``depth`` symbols or more, which is all that a search of
    that length looks at.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int) -> None:
        size = len(text)
        rank, span = text.astype(np.int64), 1
        while span < depth:
            later = np.full(size, -1, np.int64)
            later[: size - span] = rank[span:]
            key = rank * (size + alphabet + 2) + later + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            span *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        before = text[self.suffixes - 1]  # the transform; place 0 is preceded by the last symbol
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.tree = WaveletMatrix(before, self.bits)
        counts = np.bincount(text, minlength=alphabet)
        self.first = np.cumsum(counts) - counts  # suffixes that begin with a smaller symbol
        # Where a symbol's run begins after the last level: runs stand in order of reversed bits.
        symbols = np.arange(alphabet)
        mirrored = np.zeros(alphabet, np.int64)
        for bit in range(self.bits):
            mirrored |= (symbols >> bit & 1) << (self.bits - 1 - bit)
        turn = np.argsort(mirrored, kind="stable")
        starts = np.empty(alphabet, np.int64)
        starts[turn] = np.cumsum(counts[turn]) - counts[turn]
        self.starts = starts

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics from each row's end: how many symbols match, and the interval.

        A row stops growing once one occurrence is left; the caller's rows occur in the text, so
        that occurrence is the row's own and the rest of it matches too.
        """
        rows, length = patterns.shape
        low, high = np.zeros(rows, np.int64), np.full(rows, len(self.suffixes), np.int64)
        matched = np.zeros(rows, np.int64)
        active = np.arange(rows)
        for step in range(length - 1, -1, -1):
            symbols = patterns[active, step]
            if step == length - 1:
                ends = np.r_[self.first, len(self.suffixes)]
                new_low, new_high = self.first[symbols], ends[symbols + 1]
            else:
                both = self.tree.rank(
                    np.concatenate([symbols, symbols]),
                    np.concatenate([low[active], high[active]]),
                    self.starts,
                )
                base = self.first[symbols]
                new_low, new_high = base + both[: len(active)], base + both[len(active) :]
            found = new_high > new_low
            active = active[found]
            low[active], high[active] = new_low[found], new_high[found]
            matched[active] += 1
            active = active[high[active] - low[active] > 1]
            if not len(active):
                break
        return matched, low, high
