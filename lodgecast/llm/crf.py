"""A linear-chain conditional random field with two labels over sequences of hashed features.

A sequence is a list of feature indices per position and a kind per position (0 or 1): the step
into a position has weights of its own for each kind, so neighbours that belong together can
pull their labels together harder than others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 15
LABELS, KINDS = 2, 2
#: The weights of one model in a row: features of label 1 against label 0, then start, then steps.
SIZE = 2**BITS + LABELS + KINDS * LABELS * LABELS

Sequence = tuple[list[np.ndarray], list[int]]  # features and kinds by position


@dataclass(frozen=True)
class Settings:
    epochs: int = 6
    rate: float = 0.2
    decay: float = 1e-5


def _parts(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = 2**BITS + LABELS
    return weights[2**BITS : steps], weights[steps:].reshape(KINDS, LABELS, LABELS)


def unary(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Score of label 1 over label 0 for each position."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    return np.add.reduceat(weights[np.concatenate(rows)], starts)


def viterbi(weights: np.ndarray, sequence: Sequence) -> list[int]:
    """The most likely labels; ties go to label 0."""
    rows, kinds = sequence
    if not rows:
        return []
    start, step = _parts(weights)
    by_kind = step.tolist()
    own = unary(weights, rows).tolist()
    zero, one = float(start[0]), float(start[1]) + own[0]
    back: list[tuple[int, int]] = []
    for kind, score in zip(kinds[1:], own[1:]):
        (s00, s01), (s10, s11) = by_kind[kind]
        from0, from1 = zero + s00, one + s10
        to0, to1 = zero + s01, one + s11
        back.append((int(from1 > from0), int(to1 > to0)))
        zero, one = max(from0, from1), max(to0, to1) + score
    labels = [int(one > zero)]
    for choice in reversed(back):
        labels.append(choice[labels[-1]])
    return labels[::-1]


def gradient(
    weights: np.ndarray, sequence: Sequence, labels: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood: by position (for its features), by start label, by step."""
    rows, kinds = sequence
    start, by_kind = _parts(weights)
    step = by_kind[np.array(kinds)]  # of each position; that of the first is not used
    own = np.zeros((len(rows), LABELS))
    own[:, 1] = unary(weights, rows)
    n = len(rows)
    forward, backward = np.zeros((n, LABELS)), np.zeros((n, LABELS))
    forward[0] = start + own[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + step[t], axis=0) + own[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(step[t + 1] + own[t + 1] + backward[t + 1], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    chance = np.exp(forward + backward - total)
    target = np.array(labels)
    at_start = -chance[0]
    at_start[target[0]] += 1
    steps = np.zeros((KINDS, LABELS, LABELS))
    if n > 1:
        into = np.array(kinds[1:])
        pairs = forward[:-1, :, None] + step[1:] + (own[1:] + backward[1:])[:, None, :] - total
        np.subtract.at(steps, into, np.exp(pairs))
        np.add.at(steps, (into, target[:-1], target[1:]), 1)
    return target - chance[:, 1], at_start, steps


def fit(pages: list[tuple[Sequence, list[int]]], settings: Settings = Settings()) -> np.ndarray:
    """Weights after passes of adaptive gradient steps over the pages in the given order."""
    weights, seen = np.zeros(SIZE), np.full(SIZE, 1e-3)
    tail = np.arange(2**BITS, SIZE)
    for _ in range(settings.epochs):
        for sequence, labels in pages:
            rows = sequence[0]
            if not rows:
                continue
            by_place, at_start, steps = gradient(weights, sequence, labels)
            places = np.concatenate(rows)
            slope = np.repeat(by_place, [len(r) for r in rows])
            index, where = np.unique(places, return_inverse=True)
            index = np.r_[index, tail]
            total = np.r_[np.bincount(where, slope), at_start, steps.ravel()]
            total -= settings.decay * weights[index]
            seen[index] += total**2
            weights[index] += settings.rate * total / np.sqrt(seen[index])
    return weights
