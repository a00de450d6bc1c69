"""Longest common extensions over a sequence of symbols, from a difference cover.

Only suffixes at places in the cover are sorted, about a fifth of them. For any two places there is
a shift below the cover's modulus that brings both to sorted suffixes, so a query compares fewer
words than the modulus and then takes a range minimum over the sorted suffixes' common prefixes.
"""

from __future__ import annotations

import numpy as np

# A perfect difference set; every residue but 0 is the difference of one pair.
MODULUS = 31
COVER = (1, 5, 11, 24, 25, 27)

_QUERIES = 65_536  # answered at a time


def _shifts() -> np.ndarray:
    """For each pair of residues the smallest shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    a, b, shift = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    return np.argmax(inside[a + shift] & inside[b + shift], axis=2)


_SHIFT = _shifts()


class CoverLce:
    """``lce(i, j)``: how many symbols from place i on equal those from place j on."""

    def __init__(self, symbols: np.ndarray) -> None:
        size, v = len(symbols), MODULUS
        kinds = int(symbols.max()) + 1 if size else 0
        # Past the end every place has a symbol of its own, so no two suffixes are equal.
        self.size = size
        self.symbols = np.r_[symbols.astype(np.int64), kinds + np.arange(2 * v)]
        self.places = np.flatnonzero(np.isin(np.arange(size) % v, COVER))
        samples = len(self.places)
        self.sample = np.full(size + 2 * v, -1, np.int64)
        self.sample[self.places] = np.arange(samples)
        order, rank = self._by_block(int(kinds + 2 * v).bit_length())
        # Ranks by blocks of v, 2v, 4v, ... symbols, until all suffixes differ.
        self.levels, step = [rank], v
        while samples and rank.max() + 1 < samples:
            later = self._ranks(rank, self.places + step)
            key = rank * (samples + 1) + later + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(samples, np.int64)
            rank[order] = np.cumsum(np.r_[False, np.diff(key[order]) != 0])
            self.levels.append(rank)
            step *= 2
        self.rank = rank
        self._sparse_table(self._neighbours(order))

    def _by_block(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Order and rank of the samples by their first v symbols."""
        per = 63 // bits
        columns = []
        for first in range(0, MODULUS, per):
            packed = np.zeros(len(self.places), np.int64)
            for at in range(first, min(first + per, MODULUS)):
                packed = packed << bits | self.symbols[self.places + at]
            columns.append(packed)
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        for column in columns:
            new[1:] |= np.diff(column[order]) != 0
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return order, rank

    def _ranks(self, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ranks of the samples at the places; -1 past the end."""
        return np.append(rank, -1)[self.sample[np.minimum(places, self.size)]]

    def _first_difference(self, a: np.ndarray, b: np.ndarray, reach: np.ndarray | int) -> np.ndarray:
        """Symbols that match before the first difference, ``reach`` at most (at most v)."""
        steps = np.arange(MODULUS)
        differ = self.symbols[a[:, None] + steps] != self.symbols[b[:, None] + steps]
        return np.minimum(np.where(differ.any(1), differ.argmax(1), MODULUS), reach)

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbours in the sorted samples."""
        a, b = self.places[order[:-1]], self.places[order[1:]]
        length = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            left, right = (self._ranks(self.levels[level], x + length) for x in (a, b))
            length += np.where((left == right) & (left >= 0), MODULUS << level, 0)
        for at in range(0, len(a), _QUERIES):
            part = slice(at, at + _QUERIES)
            length[part] += self._first_difference(a[part] + length[part], b[part] + length[part], MODULUS)
        return length

    def _sparse_table(self, lowest: np.ndarray) -> None:
        rows = [lowest]
        while 2 ** len(rows) <= len(lowest):
            half = 2 ** (len(rows) - 1)
            row = rows[-1].copy()
            row[:-half] = np.minimum(row[:-half], rows[-1][half:])
            rows.append(row)
        self.table = np.stack(rows)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different places from 0 to the size (there nothing follows)."""
        parts = [
            self._lce(i[at : at + _QUERIES], j[at : at + _QUERIES]) for at in range(0, len(i), _QUERIES)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def _lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        length = self._first_difference(i, j, shift)
        left, right = self._ranks(self.rank, i + length), self._ranks(self.rank, j + length)
        on = np.flatnonzero((length == shift) & (left >= 0) & (right >= 0))
        low, high = np.minimum(left[on], right[on]), np.maximum(left[on], right[on])
        level = np.frexp(high - low)[1] - 1
        length[on] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return length
