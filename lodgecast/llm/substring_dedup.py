"""Substring dedup: word windows that an earlier document holds, found with FM-indexes.

A window of 13 words is placed by its anchor, the 4 words in it with the smallest hash (the first
of equal ones). Consecutive windows with one anchor make a segment. Equal windows have equal
anchors, so dealing segments to shards by anchor brings all occurrences of a window to one shard,
and no document has to visit any other shard: the work grows with the text, not with text times
shards.

In a shard, segments whose anchor only one document holds are out. The others are indexed
(distinct ones once, with the smallest document that holds them) in an FM-index over their words;
all of them stream through it by backward search. Where a whole window matches, the smallest
document of its interval says whether an earlier document holds it.

Segments travel as one compressed row per batch of documents and shard, in which equal segments
of later documents are settled beforehand, so a passage that a third of all documents share
costs a shard one entry per batch. Found stretches are joined back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.common import whole_text
from lodgecast.llm.fixed_size import key_bitmap, marked_keys
from lodgecast.llm.fm_index import FmIndex
from lodgecast.plans.storage import stored

WINDOW, ANCHOR = 13, 4
SHARD_BYTES = 4 << 20  # of text per shard, about
BATCH_BYTES = 8 << 20  # of text whose segments are packed together
CACHED_WORDS = 400_000
_NO_ID = 2**63 - 1  # stands for a null id: after every other
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR):
    """Anchor hashes, first words and ends of a text's segments."""
    count = len(words) - window + 1
    if count < 1:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    own = np.array([_words[w] for w in words], np.uint64)
    grams = np.zeros(len(words) - anchor + 1, np.uint64)
    for j in range(anchor):
        grams = grams * _MULTIPLIER + own[j : len(grams) + j]
    grams = _mix(grams)
    best, at = grams[:count].copy(), np.arange(count)
    for j in range(1, window - anchor + 1):
        other = grams[j : count + j]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], count] - 1
    return best[first], first, last + window


# -- packing segments for the shuffle --------------------------------------------------------------


class _Batch:
    """Segments of some documents, by shard."""

    def __init__(self, shards: int) -> None:
        self.shards = shards
        self.size = 0
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.parts: list[bytes] = []

    def add(self, doc_id: int, copy: int, text: bytes) -> None:
        words = text.split()
        anchors, first, end = segments(words)
        if len(anchors):
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.r_[0, ends[:-1]]
            spans = zip(starts[first].tolist(), (ends[end - 1] - 1).tolist())
            self.parts += [joined[a:b] for a, b in spans]
            ids = np.full(len(first), doc_id, np.int64)
            self.rows.append((anchors, ids, np.full(len(first), copy, np.int64), first, end - first))
        self.size += len(text)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        if not self.rows:
            return
        anchors, ids, copies, first, length = map(np.concatenate, zip(*self.rows))
        shard = (anchors % np.uint64(self.shards)).astype(np.int64)
        # Of equal segments only those of the smallest document go on; the others are settled.
        smallest: dict[bytes, int] = {}
        id_list = ids.tolist()
        for part, doc_id in zip(self.parts, id_list):
            if smallest.setdefault(part, doc_id) > doc_id:
                smallest[part] = doc_id
        open_ = np.array([smallest[p] == i for p, i in zip(self.parts, id_list)], bool)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0])
        codec = pa.Codec("zstd", 3)
        for members in np.split(order, cuts[1:]):
            going, settled = members[open_[members]], members[~open_[members]]
            texts = [self.parts[i] for i in going]
            arrays = [
                (anchors[going] >> np.uint64(24)).astype(np.uint32),
                ids[going],
                copies[going].astype(np.uint32),
                first[going].astype(np.int32),
                length[going].astype(np.int32),
                np.fromiter(map(len, texts), np.int32, len(texts)),
                ids[settled],
                copies[settled].astype(np.uint32),
                first[settled].astype(np.int32),
                length[settled].astype(np.int32),
            ]
            raw = b"".join([np.array([len(going), len(settled)], np.int64).tobytes(),
                            *[a.tobytes() for a in arrays], *texts])
            yield int(shard[members[0]]), len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


_GOING = (np.uint32, np.int64, np.uint32, np.int32, np.int32, np.int32)
_SETTLED = (np.int64, np.uint32, np.int32, np.int32)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray], bytes]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    counts, at, found = np.frombuffer(raw, np.int64, 2), 16, []
    for kinds, count in zip((_GOING, _SETTLED), counts.tolist()):
        arrays = []
        for kind in kinds:
            arrays.append(np.frombuffer(raw, kind, count, at))
            at += arrays[-1].nbytes
        found.append(arrays)
    return found[0], found[1], raw[at:]


# -- one shard -------------------------------------------------------------------------------------


def covered(
    parts: list[bytes], ids: np.ndarray, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of ``parts`` covered by windows that a part of a smaller id holds.

    Returns for each stretch its part, first word and end.
    """
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(p, len(numbers)) for p in parts], np.int64)
    holder = np.full(len(numbers), _NO_ID, np.int64)
    np.minimum.at(holder, which, ids)
    symbols: dict[bytes, int] = {}
    coded = [[symbols.setdefault(w, len(symbols) + 1) for w in p.split(b" ")] for p in numbers]
    lengths = np.array([len(c) for c in coded], np.int64)
    text = np.array([x for c in coded for x in (*c, 0)], np.int64)  # 0 ends a part
    starts = np.cumsum(lengths + 1) - lengths - 1
    index = FmIndex(text, len(symbols) + 1, window)
    # Every window of every distinct part streams through the index.
    counts = lengths - window + 1
    of_part = np.repeat(np.arange(len(coded)), counts)
    nth = np.arange(len(of_part)) - np.repeat(np.cumsum(counts) - counts, counts)
    patterns = text[(starts[of_part] + nth)[:, None] + np.arange(window)]
    _, low, high = index.search(patterns)
    held_by = holder[np.repeat(np.arange(len(coded)), lengths + 1)][index.suffixes]
    spans, where = np.unique(np.stack([low, high], 1), axis=0, return_inverse=True)
    # Intervals of whole windows do not overlap; those that stopped early hold one suffix.
    edges = spans.ravel()
    padded = np.r_[held_by, _NO_ID]
    least = np.minimum.reduceat(padded, edges)[::2][where.ravel()]
    # Back to the occurrences: a window counts against every later document.
    offsets = np.cumsum(counts) - counts
    occ_counts = counts[which]
    occ = np.repeat(np.arange(len(parts)), occ_counts)
    place = np.arange(len(occ)) - np.repeat(np.cumsum(occ_counts) - occ_counts, occ_counts)
    hit = least[offsets[which[occ]] + place] < ids[occ]
    occ, place = occ[hit], place[hit]
    if not len(occ):
        none = np.empty(0, np.int64)
        return none, none, none
    new = np.r_[True, (occ[1:] != occ[:-1]) | (place[1:] != place[:-1] + 1)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(occ)] - 1
    return occ[begin], place[begin], place[end] + window


def _shard_stretches(shard: pd.DataFrame) -> pd.DataFrame:
    going, settled, texts = zip(*map(_unpack, shard["segments"]))
    anchors, ids, copies, first, length, sizes = map(np.concatenate, zip(*going))
    done = [np.concatenate(a) for a in zip(*settled)]
    # Segments whose anchor a single document holds cannot be anywhere else.
    order = np.lexsort((ids, anchors))
    runs = np.flatnonzero(np.r_[True, np.diff(anchors[order].astype(np.int64)) != 0]) if len(order) else order
    several = np.zeros(len(ids), bool)
    if len(order):
        ends = np.r_[runs[1:], len(order)] - 1
        many = ids[order][runs] != ids[order][ends]
        several[order] = np.repeat(many, np.diff(np.r_[runs, len(order)]))
    kept = np.flatnonzero(several)
    frames = [(done[0], done[1].astype(np.int64), done[2].astype(np.int64), (done[2] + done[3]).astype(np.int64))]
    if len(kept):
        joined = b"".join(texts)
        ends_at = np.cumsum(sizes.astype(np.int64))
        parts = [joined[b - n : b] for b, n in zip(ends_at[kept].tolist(), sizes[kept].tolist())]
        part, begin, end = covered(parts, ids[kept])
        at = kept[part]
        frames.append((ids[at], copies[at].astype(np.int64), first[at] + begin, first[at] + end))
    columns = [np.concatenate(c) for c in zip(*frames)]
    return pd.DataFrame(dict(zip(("doc", "copy", "first", "end"), columns)))


# -- the whole -------------------------------------------------------------------------------------


def repeated_stretches(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc, copy, first, end``: word stretches that windows of smaller documents cover.

    ``doc`` is the id (the largest number for null) and ``copy`` the text's checksum.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _Batch(shards)
        for rows in batches:
            texts = rows.column(2).cast(pa.binary())
            for doc_id, copy, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts):
                batch.add(doc_id, copy, text.as_py())
                if batch.size >= BATCH_BYTES:
                    yield _rows(batch)
                    batch = _Batch(shards)
        yield _rows(batch)

    def _rows(batch: _Batch) -> pa.RecordBatch:
        packed = list(batch.packed())
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in packed], pa.int64()), pa.array([b for _, b in packed], pa.binary())],
            ["shard", "segments"],
        )

    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.crc32(whole_text()).alias("copy"),
        whole_text().alias("text"),
    )
    dealt = keyed.mapInArrow(deal, "shard long, segments binary")
    return dealt.groupBy("shard").applyInPandas(
        _shard_stretches, "doc long, copy long, first long, end long"
    )


def drop_repeated_windows(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (kept words joined by one space) per row of ``docs``.

    A word goes if one of the 13-word windows over it also starts in a document with a smaller
    doc_id; windows are those of the input. Rows of one doc_id do not count against each other;
    rows without id come after all others and never count against any. Null, empty and short
    texts have no window and keep their words. Repeated rows are repeated. An empty table gives
    an empty table. ``docs`` is a scan or a stored frame.
    """
    stretches = stored(repeated_stretches(docs, shard_bytes), "stretches")
    place = F.xxhash64("doc", "copy").alias("place")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(stretches.select(place)))
    by_row = stretches.groupBy("doc", "copy").agg(F.collect_list(F.struct("first", "end")).alias("gone"))
    keyed = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.crc32(whole_text()).alias("copy"),
        whole_text().alias("text"),
    ).select("doc_id", "doc", "copy", place, "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_words long, n_removed long, kept string"

    # Texts that the bitmap clears keep all words and stay where they are; the others are joined.
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = marked_keys(bits.value, batch.column(3).to_numpy())
            left = batch.filter(pa.array(~marked))
            yield _cut(left.column(0), left.column(4), [None] * left.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.filter(pa.array(marked_keys(bits.value, batch.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays(
                [chosen.column(0), chosen.column(1), chosen.column(2), chosen.column(4)],
                ["doc_id", "doc", "copy", "text"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _cut(batch.column(0), batch.column(1), [g if g.is_valid else None for g in batch.column(2)])

    untouched = keyed.mapInArrow(clear, result)
    texts = keyed.mapInArrow(touched, f"doc_id {kind}, doc long, copy long, text string")
    joined = texts.join(by_row, ["doc", "copy"], "left").select("doc_id", "text", "gone")
    return untouched.unionByName(joined.mapInArrow(cut, result))


def _cut(ids: pa.Array, texts: pa.Array, gone: list) -> pa.RecordBatch:
    """Rows of (id, words, removed words, kept text) without the words of each row's stretches."""
    total, removed, kept = [], [], []
    for text, stretches in zip(texts.cast(pa.binary()), gone):
        words = text.as_py().split()
        total.append(len(words))
        if stretches is not None:
            marks = np.zeros(len(words) + 1, np.int64)
            np.add.at(marks, stretches.values.field("first").to_numpy(), 1)
            np.subtract.at(marks, stretches.values.field("end").to_numpy(), 1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()]
        removed.append(total[-1] - len(words))
        kept.append(b" ".join(words))
    columns = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_words", "n_removed", "kept"])


def substring_report(docs: DataFrame) -> DataFrame:
    return drop_repeated_windows(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
