"""Arrays of fixed size over tables of any size: sums and bitmaps that tasks make and combine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BITMAP_BITS = 26  # of the bitmaps that filter before a shuffle; full ones only filter less
_PARTS = 64  # in which the arrays are combined
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def combined(
    df: DataFrame,
    partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    combine: np.ufunc,
    empty: np.ndarray,
) -> np.ndarray:
    """An array of the size of ``empty``, combined over all partitions of ``df``.

    Each task sends its array compressed and in parts, which are combined part by part; the
    driver gets one array, however large the table.
    """
    kind, size = empty.dtype, empty.nbytes // _PARTS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        parts = [codec.compress(x.tobytes(), asbytes=True) for x in np.split(partial(batches), _PARTS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "cells"]
        )

    def add(part: pd.DataFrame) -> pd.DataFrame:
        codec = pa.Codec("zstd")
        cells = [np.frombuffer(codec.decompress(x, size, asbytes=True), kind) for x in part["cells"]]
        total = cells[0]
        for more in cells[1:]:
            total = combine(total, more)
        return pd.DataFrame({"part": part["part"].iloc[:1].to_numpy(), "cells": [total.tobytes()]})

    schema = "part int, cells binary"
    rows = df.mapInArrow(send, schema).groupBy("part").applyInPandas(add, schema).collect()
    if not rows:
        return empty
    return np.concatenate([np.frombuffer(r["cells"], kind) for r in sorted(rows, key=lambda r: r["part"])])


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each key in a bitmap."""
    spread = (keys.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - BITMAP_BITS)
    return (spread >> np.uint64(3)).astype(np.int64), (spread & np.uint64(7)).astype(np.uint8)


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of fixed size over a column of longs: a key it lacks is surely not in the column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(2**BITMAP_BITS // 8, np.uint8)
        for batch in batches:
            byte, bit = _places(batch.column(0).to_numpy(zero_copy_only=False))
            np.bitwise_or.at(bits, byte, np.left_shift(np.uint8(1), bit))
        return bits

    return combined(keys, mark, np.bitwise_or, np.zeros(2**BITMAP_BITS // 8, np.uint8))


def marked_keys(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    byte, bit = _places(keys)
    return (bits[byte] >> bit & np.uint8(1)).astype(bool)
