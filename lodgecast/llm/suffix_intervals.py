"""Maximal repeats of byte strings, from the common-prefix intervals of an enhanced suffix array.

Suffixes are sorted by prefix doubling, in which only those still tied with others are sorted again.
Neighbours' common prefixes come from the ranks of the doubling steps. A scan with a stack then
finds the intervals of suffixes with a common prefix; one whose suffixes are not all preceded by
the same byte cannot be extended to either side and is a maximal repeat, with all the suffixes of
the interval as its occurrences.
"""

from __future__ import annotations

import numpy as np

_PACKED, _BITS = 7, 9  # symbols in the first key; a byte plus one, 0 past the end of a text


class SuffixIntervals:
    """Repeats of at least ``least`` bytes within and between ``texts``.

    An occurrence may start at the first ``starts[k]`` places of text k, from each of which it has
    ``least`` bytes or more. Texts end before anything that follows them. A text that is ``copied``
    stands for several equal ones; each of its suffixes is a leaf with as many occurrences.
    """

    def __init__(self, texts: list[bytes], starts: np.ndarray, least: int, copied: np.ndarray) -> None:
        if least < _PACKED:
            raise ValueError(f"repeats of less than {_PACKED} bytes are not told apart")
        sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(sizes + _PACKED) - sizes - _PACKED
        gap = bytes(_PACKED)
        self.symbols = np.frombuffer(gap.join([*texts, b""]), np.uint8).astype(np.int64) + 1
        ends = (self.first + sizes)[:, None] + np.arange(_PACKED)
        self.symbols[ends.ravel()] = 0
        self.least, self.sizes, self.copied = least, sizes, copied
        self._sort(int(sizes.max(initial=0)))
        may_start = np.zeros(len(self.symbols) + 1, np.int64)
        np.add.at(may_start, self.first, 1)
        np.subtract.at(may_start, self.first + starts, 1)
        may_start = np.cumsum(may_start[:-1]) > 0
        self.order = self.order[may_start[self.order]]
        self.prefix = self._common_prefixes()

    def _sort(self, longest: int) -> None:
        size = len(self.symbols)
        key = np.zeros(size, np.int64)
        for at in range(_PACKED):
            key <<= _BITS
            key[: size - at] |= self.symbols[at:]
        alone = np.zeros(size, bool)  # a key past the end of its text equals no other
        for at in range(_PACKED):
            alone[: size - at] |= self.symbols[at:] == 0
        order = np.argsort(key, kind="stable")
        ordered, single = key[order], alone[order]
        new = np.ones(size, bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | single[1:] | single[:-1]
        del key, ordered
        # A rank is the place in the order of the first suffix tied with this one.
        rank = np.empty(size, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(size), 0))
        self.levels = [(_PACKED, rank)]
        span = _PACKED
        tied = np.flatnonzero(~(new & np.r_[new[1:], True])) if size else np.zeros(0, np.int64)
        while len(tied) and span < longest:
            places = order[tied]
            later = np.minimum(places + span, size - 1)  # inside the text or its end, for tied ones
            key = rank[places].astype(np.int64) * (size + 1) + rank[later]
            turn = np.argsort(key, kind="stable")
            places, key = places[turn], key[turn]
            order[tied] = places
            new = np.ones(len(tied), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[places] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            span *= 2
            self.levels.append((span, rank))
            tied = tied[~(new & np.r_[new[1:], True])]
        self.order = order

    def _common_prefixes(self) -> np.ndarray:
        """For each suffix in order, its common prefix with the one before; 0 if below ``least``."""
        prefix = np.zeros(len(self.order), np.int64)
        span, rank = next((x for x in reversed(self.levels) if x[0] <= self.least), (0, None))
        if rank is None or not len(prefix):
            return prefix
        own = rank[self.order]
        at = np.flatnonzero(own[1:] == own[:-1]) + 1
        a, b = self.order[at - 1], self.order[at]
        length, last = np.zeros(len(at), np.int64), len(self.symbols) - 1
        for span, rank in reversed(self.levels):
            same = rank[np.minimum(a + length, last)] == rank[np.minimum(b + length, last)]
            length += np.where(same, span, 0)
        going = np.arange(len(at))
        for _ in range(_PACKED):  # what is left is shorter than the first key
            left, right = (self.symbols[np.minimum(x[going] + length[going], last)] for x in (a, b))
            going = going[(left == right) & (left > 0)]
            length[going] += 1
        prefix[at] = np.where(length >= self.least, length, 0)
        return prefix

    def groups(self) -> list[tuple[int, int, int]]:
        """Maximal repeats: length, and the first and last place in ``order`` of the occurrences."""
        before = np.r_[0, self.symbols][self.order]  # 0 before a text, which differs from all
        change = np.ones(len(before), np.int64)
        change[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        changes = np.cumsum(change)
        # Suffixes between two short prefixes; where all have one byte before them, the stretch
        # one byte further left holds the same repeats, longer.
        begin = np.flatnonzero(self.prefix == 0)
        end = np.r_[begin[1:], len(self.prefix)] - 1
        found: list[tuple[int, int, int]] = []
        # Copies differ in what is before and behind the whole of them only.
        whole = np.zeros(len(self.symbols), np.int64)
        whole[self.first[self.copied]] = self.sizes[self.copied]
        own = whole[self.order]
        found += [(int(own[k]), k, k) for k in np.flatnonzero(own).tolist()]
        for i, j in zip(begin.tolist(), end.tolist()):
            if i < j and changes[j] > changes[i]:
                self._scan(i, j, changes, found)
        return found

    def _scan(self, i: int, j: int, changes: np.ndarray, found: list[tuple[int, int, int]]) -> None:
        stack: list[tuple[int, int]] = []  # length and left end of the open intervals
        lengths = self.prefix[i + 1 : j + 1].tolist()
        for place, length in enumerate([*lengths, 0], i + 1):
            left = place - 1
            while stack and stack[-1][0] > length:
                top, left = stack.pop()
                if changes[place - 1] > changes[left]:
                    found.append((top, left, place - 1))
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, left))

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte and end of the stretches that maximal repeats cover."""
        reach = np.zeros(len(self.order), np.int64)
        # Inner intervals, whose prefixes are longer, come first; each suffix is reached once.
        behind: dict[int, int] = {}
        for length, i, j in self.groups():
            at = i
            while at <= j:
                if at in behind:
                    at = behind[at]
                else:
                    reach[at] = length
                    behind[at] = at = at + 1
            behind[i] = j + 1
        hit = reach > 0
        first, end = self.order[hit], self.order[hit] + reach[hit]
        order = np.argsort(first)
        first, end = first[order], np.maximum.accumulate(end[order])
        new = np.ones(len(first), bool)
        new[1:] = first[1:] > end[:-1]
        first, end = first[new], end[np.r_[new[1:], True]] if len(first) else end
        text = np.searchsorted(self.first, first, "right") - 1
        return text, first - self.first[text], end - self.first[text]
