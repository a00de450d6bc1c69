"""Suffix-array dedup: long byte strings that start anywhere else in the corpus go everywhere.

A window of 400 bytes is placed by its anchor, the 64 bytes in it with the smallest hash (the first
of equal ones). Consecutive windows with one anchor make a segment. Equal windows have equal
anchors, so they meet where segments are dealt by anchor, and a corpus of any size falls into
groups that know nothing of each other. Equal segments are one from then on, with a count; those
whose anchor is nowhere else are out. In every shard an enhanced suffix array over its segments
gives the maximal repeats, and their occurrences are taken back to the texts.

A hot anchor (a passage that very many documents hold, in different surroundings) is split: its
windows are dealt again by how far before the anchor they start, 16 starts at a time, together
with the bytes that such windows share; where that still is hot, each start by the whole window.
Each step is a function of the window, so equal windows still meet, and no group grows with the
corpus. Texts travel twice at most: once to cut the segments looked at, and once to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.common import whole_text, wide_hash
from lodgecast.llm.fixed_size import key_bitmap, marked_keys
from lodgecast.llm.suffix_intervals import SuffixIntervals
from lodgecast.plans.storage import stored

WINDOW, GRAM = 400, 64
WIDTHS = (16, 1)  # window starts per anchor that are dealt together once an anchor is hot
HOT_SEGMENTS = 2_048  # different segments of one key in a shard; more are dealt again
SHARD_BYTES = 1 << 20  # of segments; sorting them takes some eighty times that
BATCH_BYTES = 256 << 10  # of texts whose anchors are found together
CUT_ROWS = 512  # texts that are cut together
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(2**24 - 1)  # the bits of a place beside a hash
_PIECE_BYTES = 1 << 23
MOST_STARTS = 4_096  # windows of a segment
_SEGMENTS = "key long, s1 long, s2 long, u1 long, u2 long, first int, starts int, copies long, places long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the text, where its anchor begins; and the hashes of the text's grams."""
    count = len(text) - window + 1
    if count < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(text) > _PIECE_BYTES + window:
        pieces = []
        for first in range(0, count, _PIECE_BYTES):
            at, hashes = anchors(text[first : first + _PIECE_BYTES + window - 1], window, gram)
            pieces.append((at + first, hashes[:_PIECE_BYTES]))
        return tuple(np.concatenate(x) for x in zip(*pieces))
    hashes, span = _mix(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)), 1
    while span < gram:  # of grams of 1, 2, 4, ... bytes; the last two may overlap
        step = min(span, gram - span)
        hashes = _mix(hashes[: len(hashes) - step] * _MULTIPLIER + hashes[step:])
        span += step
    # The smallest of a window's grams, the first of equal ones, by windows of 1, 2, 4, ... grams.
    best = hashes & ~_PLACE | np.arange(len(hashes), dtype=np.uint64)
    wide = 1
    while wide < window - gram + 1:
        step = min(wide, window - gram + 1 - wide)
        best = np.minimum(best[: len(best) - step], best[step:])
        wide += step
    return (best & _PLACE).astype(np.int64), hashes


def _signed(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def segments(
    texts: list[bytes], width: int, window: int = WINDOW, gram: int = GRAM
) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """Text, key, first byte, window starts, anchors and content of the texts' segments.

    A segment's windows follow each other, have equal anchors and start at most ``width`` places
    apart, counted from the anchor; the key is the hash of the bytes common to all windows that
    could be among them. Where any distance is allowed the anchor's bytes are what is common, and a
    text that repeats itself stays in few segments although its anchor moves along.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes) - sizes
    joined = b"".join(texts)
    at, hashes = anchors(joined, window, gram)
    inside = np.zeros(len(joined) + 1, np.int64)
    np.add.at(inside, offset, 1)
    np.subtract.at(inside, offset + np.maximum(sizes - window + 1, 0), 1)
    start = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)  # windows that cross no end of a text
    if not len(start):
        return
    at = at[start]
    ahead = (at - start) // width
    new = np.ones(len(at), bool)
    if width == window - gram + 1:
        new[1:] = (np.diff(start) != 1) | (hashes[at[1:]] != hashes[at[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - begin) % MOST_STARTS == 0
    else:
        new[1:] = (np.diff(start) != 1) | (np.diff(at) != 0) | (np.diff(ahead) != 0)
    common = at[new] - ahead[new] * width
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    first = start[new]
    moved = ~new
    moved[1:] &= at[1:] != at[:-1]
    places = 1 + np.add.reduceat(moved.astype(np.int64), np.flatnonzero(new))
    text = np.searchsorted(offset, first, "right") - 1
    columns = (text, first, count, common, places, offset[text])
    for k, a, n, c, p, o in zip(*(x.tolist() for x in columns)):
        key = xxhash.xxh3_64_intdigest(joined[c : c - width + 1 + window]) - (1 << 63)
        yield k, key, a - o, n, p, joined[a : a + n - 1 + window]


def _cut_segments(units: DataFrame, width: int, window: int, gram: int) -> DataFrame:
    """The segments of ``u1, u2, copies, text``, without their bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(3).cast(pa.binary())).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(sizes // BATCH_BYTES, prepend=0)).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                units = list(zip(*(part.column(k).to_pylist() for k in range(3))))
                rows = []
                texts = part.column(3).cast(pa.binary()).to_pylist()
                for k, key, first, starts, places, content in segments(texts, width, window, gram):
                    u1, u2, copies = units[k]
                    content_hash = _signed(xxhash.xxh3_128_digest(content))
                    rows.append((key, *content_hash, u1, u2, first, starts, copies, copies * places))
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()] * 2
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, _names(_SEGMENTS))

    return units.select("u1", "u2", "copies", "text").mapInArrow(cut, _SEGMENTS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _only_marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``u1, u2, copies, text`` that a bitmap over ``u1`` of ``keys`` leaves."""
    bits = texts.sparkSession.sparkContext.broadcast(key_bitmap(keys.select("u1")))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked_keys(bits.value, batch.column(0).to_numpy())))

    return texts.mapInArrow(chosen, texts.schema)


def _contents(wanted: DataFrame, units: DataFrame, window: int) -> DataFrame:
    """``wanted`` (one row per segment, with where to find it) with its bytes in ``content``."""
    spots = wanted.groupBy("u1", "u2").agg(
        F.collect_list(F.struct("key", "s1", "s2", "copies", "first", "starts")).alias("spots")
    )
    names = ["key", "s1", "s2", "copies", "starts", "content"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, spots in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
                whole = text.as_py()
                for s in spots.as_py():
                    content = whole[s["first"] : s["first"] + s["starts"] - 1 + window]
                    rows.append((s["key"], s["s1"], s["s2"], s["copies"], s["starts"], content))
                    held += len(content)
                if held > SHARD_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    # A text occurs here once, however many rows hold it.
    texts = _only_marked(units, wanted).dropDuplicates(["u1", "u2"])
    found = texts.join(spots, ["u1", "u2"]).select("text", "spots")
    return found.mapInArrow(cut, "key long, s1 long, s2 long, copies long, starts int, content binary")


def _shard_stretches(window: int):
    def stretches(shard: pd.DataFrame) -> pd.DataFrame:
        copied = shard["copies"].to_numpy() > 1
        index = SuffixIntervals(shard["content"].tolist(), shard["starts"].to_numpy(), window, copied)
        text, first, end = index.covered()
        return pd.DataFrame(
            {
                "s1": shard["s1"].to_numpy()[text],
                "s2": shard["s2"].to_numpy()[text],
                "begin": first.astype("int32"),
                "stop": end.astype("int32"),
            }
        )

    return stretches


def repeated_stretches(
    units: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    widths: tuple[int, ...] | None = None,
    hot: int = HOT_SEGMENTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``u1, u2, begin, stop``: stretches of units that windows found at another place cover.

    ``units`` are ``u1, u2, copies, text``: a text or its bytes, named by a 128-bit hash; a row
    stands for ``copies`` places, and equal rows may come repeatedly. A stretch may be reported in
    parts that overlap, never twice for the same two ends.
    """
    widths = widths or (window - gram + 1, *WIDTHS)  # first all windows of an anchor
    rows = stored(_cut_segments(units, widths[0], window, gram), "segments")
    several = rows.groupBy("key").agg(F.sum("places").alias("places")).filter("places > 1")
    several = stored(several.select("key"), "shared-keys")  # a scan, so that a hot key can be split
    shared = stored(rows.join(several, "key"), "shared-segments")
    known = shared.groupBy("s1", "s2").agg(
        F.first("key").alias("key"),
        F.sum("copies").alias("copies"),
        F.min(F.struct("u1", "u2", "first")).alias("_at"),
        F.first("starts").alias("starts"),
    )
    known = stored(known.select("key", "s1", "s2", "copies", "_at.*", "starts"), "known-segments")
    contents = _contents(known, units, window)
    crowded = known.groupBy("key").count().filter(F.col("count") > hot).select("key")
    crowded = stored(crowded, "crowded")
    split_again = len(widths) > 1 and bool(crowded.take(1))
    if split_again:
        contents = stored(contents, "contents")
        further = contents.join(crowded, "key", "left_semi")
        contents = contents.join(crowded, "key", "left_anti")
    total = known.agg(F.sum(F.col("starts") + window)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInPandas(
        _shard_stretches(window), "s1 long, s2 long, begin int, stop int"
    )
    if split_again:
        again = further.select(
            F.col("s1").alias("u1"), F.col("s2").alias("u2"), "copies", F.col("content").alias("text")
        )
        deeper = repeated_stretches(again, window, gram, widths[1:], hot, shard_bytes)
        found = found.unionByName(deeper.withColumnsRenamed({"u1": "s1", "u2": "s2"}))
    found = stored(found, "segment-stretches")
    places = shared.select("s1", "s2", "u1", "u2", "first").join(found, ["s1", "s2"])
    return places.select(
        "u1", "u2", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("stop")).alias("stop")
    ).distinct()


def drop_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    widths: tuple[int, ...] | None = None,
    hot: int = HOT_SEGMENTS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes left, in order) per row of ``docs``.

    Texts count as UTF-8. A byte goes if a string of ``window`` bytes over it also starts at any
    other place, in the same row or another one, the first of them included; strings are those of
    the input and end with their text. Repeated rows are places of their own, so both lose all.
    Null, empty and shorter texts lose nothing; null ids do not matter; an empty table gives an
    empty table. Texts of any length are read whole. ``docs`` is a scan or a stored frame.
    """
    u1, u2 = wide_hash(whole_text())
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(
        u1.alias("u1"), u2.alias("u2"), F.lit(1).cast("long").alias("copies"), whole_text().alias("text")
    )
    stretches = repeated_stretches(texts, window, gram, widths, hot, shard_bytes)
    gone = stretches.groupBy("u1", "u2").agg(F.collect_list(F.struct("begin", "stop")).alias("gone"))
    gone = stored(gone, "gone")
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(gone.select("u1")))
    keyed = docs.select("doc_id", u1.alias("u1"), u2.alias("u2"), whole_text().alias("text"))
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    # Texts that the bitmap clears lose nothing and stay where they are; the others are joined.
    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = batch.filter(pa.array(~marked_keys(bits.value, batch.column(1).to_numpy())))
            for part in _slices(left):
                yield _cut(part.column(0), part.column(3), [None] * part.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked_keys(bits.value, batch.column(1).to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _cut(part.column(0), part.column(1), [g if g.is_valid else None for g in part.column(2)])

    untouched = keyed.mapInArrow(clear, result)
    moved = keyed.mapInArrow(touched, keyed.schema).join(gone, ["u1", "u2"], "left")
    return untouched.unionByName(moved.select("doc_id", "text", "gone").mapInArrow(cut, result))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, as texts are held several times while they are cut."""
    for at in range(0, batch.num_rows, CUT_ROWS):
        yield batch.slice(at, CUT_ROWS)


def _cut(ids: pa.Array, texts: pa.Array, gone: list) -> pa.RecordBatch:
    rows = []
    for text, stretches in zip(texts.cast(pa.binary()), gone):
        whole = text.as_py()
        spans: list[list[int]] = []
        if stretches is not None:
            first = stretches.values.field("begin").to_numpy()
            order = np.argsort(first, kind="stable")
            ends = stretches.values.field("stop").to_numpy()
            for a, b in zip(first[order].tolist(), ends[order].tolist()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
        edges = [0, *(x for span in spans for x in span), len(whole)]
        kept = b"".join([whole[a:b] for a, b in zip(edges[::2], edges[1::2])])
        rows.append((len(whole), len(whole) - len(kept), len(spans), kept))
    numbers = list(zip(*rows)) or [(), (), (), ()]
    kinds = [pa.int64()] * 3 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [ids, *[pa.array(c, k) for c, k in zip(numbers, kinds)]],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def repeat_report(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
