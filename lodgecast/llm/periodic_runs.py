"""Periodic runs of words: stretches that repeat a block of q words at least four times.

For a period q every run of at least 4q words holds four neighbouring points of the grid 0, q, 2q,
..., which then have one and the same word. All grids together have n ln n points, compared by
slices; what is left are a few places, from where longest common extensions to both sides give the
whole run. A stretch found for several periods has the smallest of them, since by its length that
one divides the others. Documents of a batch are searched together, with an end symbol of its own
after each, so no run crosses documents. Everything happens inside the task that reads a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.common import whole_text
from lodgecast.llm.cover_lce import CoverLce

TIMES, LEAST_WORDS = 4, 6
BATCH_BYTES = 4 << 20  # of text searched together; a longer text is searched alone
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _grid_hits(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods where four neighbouring points of a period's grid are equal."""
    places, periods = [], []
    for q in range(1, longest // TIMES + 1):
        grid = symbols[::q]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(at):
            places.append(at * q)
            periods.append(np.full(len(at), q))
    none = np.zeros(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def find_runs(texts: list[np.ndarray]) -> list[Runs]:
    """Start, length and period of each text's runs, by start and period. Texts are word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    found: list[Runs] = [(none, none, none)] * len(texts)
    if not sizes.sum():
        return found
    kinds = max(int(t.max()) for t in texts if len(t)) + 1
    first = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.concatenate([x for k, t in enumerate(texts) for x in (t, [kinds + k])])
    place, period = _grid_hits(symbols, int(sizes.max()))
    owner = np.searchsorted(first, place, "right") - 1
    inside = place + (TIMES - 1) * period < first[owner] + sizes[owner]
    place, period, owner = place[inside], period[inside], owner[inside]
    if not len(place):
        return found
    # Only texts with such places go into the index.
    chosen = np.unique(owner)
    kept = np.concatenate([symbols[first[k] : first[k] + sizes[k] + 1] for k in chosen.tolist()])
    starts = np.cumsum(sizes[chosen] + 1) - sizes[chosen] - 1
    nth = np.searchsorted(chosen, owner)
    place = place - first[owner] + starts[nth]
    after = CoverLce(kept).lce(place, place + period)
    before = CoverLce(kept[::-1]).lce(len(kept) - place, len(kept) - place - period)
    start, end = place - before, place + period + after
    long_enough = end - start >= np.maximum(LEAST_WORDS, TIMES * period)
    start, end, period, nth = (x[long_enough] for x in (start, end, period, nth))
    order = np.lexsort((period, end, start))
    start, end, period, nth = (x[order] for x in (start, end, period, nth))
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)
    start, end, period, nth = (x[new] for x in (start, end, period, nth))
    order = np.lexsort((period, start))
    start, end, period, nth = (x[order] for x in (start, end, period, nth))
    cuts = np.searchsorted(nth, np.arange(len(chosen) + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        found[chosen[k]] = (start[a:b] - starts[k], (end - start)[a:b], period[a:b])
    return found


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query's contract wants them: a tenth of the documents, chosen by the
    checksum of the id, become periodic from some word on. Without an id nothing changes."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    block = words[a : a + 1 + (n - a) // (3 + g % 8)]
    times = -(-(n - a) // len(block))
    return words[:a] + (block * times)[: n - a]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _search(texts: list[list[bytes]]) -> list[Runs]:
    numbers = _Numbers()
    return find_runs([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts])


def _batches(
    batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None
) -> Iterator[tuple[list, list[list[bytes]], list[Runs]]]:
    """Ids, words and runs of some documents at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = text.as_py().split()
            ids.append(doc_id)
            texts.append(rewrite(doc_id, words) if rewrite else words)
            size += len(text.as_py())
            if size >= BATCH_BYTES:
                yield ids, texts, _search(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts, _search(texts)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, start, length, period``: every run of every row of ``docs``.

    A run is a longest stretch of words with smallest period q and at least max(6, 4q) words.
    Null, empty and short texts have none; repeated rows and null ids are rows like any other; an
    empty table gives an empty table. A text of any length is searched whole, by one task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, runs in _batches(batches, rewrite):
            own = np.repeat(np.arange(len(ids)), [len(r[0]) for r in runs])
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*runs)]
            own_ids = pa.array([ids[k] for k in own.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([own_ids, *columns], ["doc_id", "start", "length", "period"])

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs["text"]).alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, start long, length long, period long")


def collapse_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs, collapsed`` per row.

    The four after ``n_runs`` describe the run repeated most often (then the first, then the one
    of the smallest period) and are null without runs. ``runs`` lists all as lines of
    ``start,length,period``; ``collapsed`` has the words that no run holds after its first period,
    joined by one space. Nulls, empty, short and very long texts, repeated rows, empty tables: as
    in ``periodic_runs``; a text without words collapses to an empty string.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, runs in _batches(batches, rewrite):
            out = [(doc_id, *_row(words, *found)) for doc_id, words, found in zip(ids, texts, runs)]
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c, pa.int64()) for c in columns[:6]],
                    pa.array(columns[6], pa.string()),
                    pa.array(columns[7], pa.binary()).cast(pa.string()),
                ],
                names,
            )

    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs["text"]).alias("text"))
    longs = ", ".join(f"{n} long" for n in names[:6])
    return narrow.mapInArrow(rows, f"{longs}, runs string, collapsed string")


def _row(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    if not len(start):
        return 0, None, None, None, None, "", b" ".join(words)
    listed = list(zip(start.tolist(), length.tolist(), period.tolist()))
    s, n, q = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, start + period, 1)
    np.subtract.at(marks, start + length, 1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in listed)
    return len(listed), s, n, q, 1000 * n // q, lines, b" ".join([words[i] for i in kept])


def run_report(docs: DataFrame) -> DataFrame:
    """The planted documents' runs, with lists and collapsed texts as digests."""
    found = collapse_runs(docs, planted)
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("runs", "collapsed")]
    return found.select(*found.columns[:6], *digests)
