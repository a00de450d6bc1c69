"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Features of a text are the relative frequencies of its hashed n-grams, in several views: words,
word pairs, word shapes (``A`` upper, ``a`` lower, ``0`` digit, other signs as they are, runs
collapsed), shape pairs, and pairs of equal neighbours. All views hash into one weight vector, so
a score is a sparse dot product: a gather and a mean per view.

Training rows are dealt to shards; each shard runs follow-the-regularised-leader on its own rows,
and the shards' weights are averaged by a group-by on the weight's index. The model has a fixed
size (``2 ** BITS`` weights), whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
TRAIN_ROWS = 20_000  # bound on the labelled rows that are fitted; all rows are scored
SHARDS = 8  # at most; a shard fits ``SHARD_ROWS`` rows or more
SHARD_ROWS = 2_500
EPOCHS = 6
THRESHOLD = 0.3
CACHED_WORDS = 400_000  # per worker; hashes of further words are computed again
_VIEWS = 5
_BIAS = 2**BITS  # index of the bias, behind the hashed weights


@dataclass(frozen=True)
class Ftrl:
    """Learning rate ``alpha / (beta + sqrt(n))`` per weight, and the two penalties."""

    alpha: float = 2.0
    beta: float = 0.02
    l1: float = 1e-4
    l2: float = 1e-4


def shape(word: str) -> str:
    kinds = [
        "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word
    ]
    return "".join(c for i, c in enumerate(kinds) if i == 0 or kinds[i - 1] != c)


class _Hashes(dict):
    """Word -> its 32-bit hash, and that of its shape in the upper half."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        kind = zlib.crc32(shape(word.decode("utf-8", "replace")).encode())
        self[word] = value = kind << 32 | zlib.crc32(word)
        return value


_hashes = _Hashes()


def features(text: bytes) -> list[np.ndarray]:
    """Indices of the text's n-grams, one array per view that has any."""
    words = text.split()
    if not words:
        return []
    both = np.array([_hashes[w] for w in words], np.uint64)
    plain, kinds = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    views = [(1, plain), (2, kinds)]
    if len(words) > 1:
        mixed = np.uint64(0x9E3779B1)
        views += [
            (3, plain[:-1] * mixed + plain[1:]),
            (4, kinds[:-1] * mixed + kinds[1:]),
            (5, (plain[:-1] == plain[1:]).astype(np.uint64)),
        ]
    spread = np.uint64(0x9E3779B97F4A7C15)
    return [
        (((v + np.uint64(salt << 56)) * spread) >> np.uint64(64 - BITS)).astype(np.int64)
        for salt, v in views
    ]


def score(views: list[np.ndarray], weights: np.ndarray) -> float:
    margin = weights[_BIAS] + sum(float(weights[v].mean()) for v in views)
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, margin)))))


def fit_ftrl(texts: list[bytes], labels: list[int], settings: Ftrl, epochs: int) -> np.ndarray:
    """Weights after ``epochs`` passes over the rows in the given order."""
    rows = []
    for text in texts:
        views = features(text)
        index = np.concatenate([*views, [_BIAS]]).astype(np.int64)
        value = np.concatenate([*[np.full(len(v), 1 / len(v)) for v in views], [1.0]])
        kept, where = np.unique(index, return_inverse=True)
        rows.append((kept, np.bincount(where, value)))
    z, n, weights = (np.zeros(2**BITS + 1) for _ in range(3))
    for _ in range(epochs):
        for (index, value), label in zip(rows, labels):
            zi, ni = z[index], n[index]
            w = np.where(
                np.abs(zi) <= settings.l1,
                0.0,
                -(zi - np.sign(zi) * settings.l1)
                / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2),
            )
            margin = min(30.0, max(-30.0, float(w @ value)))
            gradient = (1 / (1 + np.exp(-margin)) - label) * value
            grown = ni + gradient**2
            z[index] = zi + gradient - (np.sqrt(grown) - np.sqrt(ni)) / settings.alpha * w
            n[index] = grown
    shrunk = np.sign(z) * settings.l1
    moved = -(z - shrunk) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
    weights[:] = np.where(np.abs(z) <= settings.l1, 0.0, moved)
    return weights


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    rows: int = TRAIN_ROWS,
    settings: Ftrl = Ftrl(),
    epochs: int = EPOCHS,
) -> np.ndarray:
    """Weights fitted to at most about ``rows`` labelled documents that are not held out.

    Rows without id or label are skipped; an id with several labels counts as 1 if at least half
    of them are 1. The rows fitted are those with the smallest hashes, so a rerun takes the same.
    Without any labelled row all weights are 0 and every score is 0.5.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("_llm_label"))
    )
    total, span = known.count(), 1 << 30
    shards = max(1, min(SHARDS, min(rows, total) // SHARD_ROWS))
    drawn = known.filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(span)) < int(span * min(1.0, rows / max(1, total)))
    )
    # About ``rows`` ids at most, so the broadcast has a fixed bound and no text is shuffled twice.
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    dealt = texts.withColumn("_llm_shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.assign(turn=[zlib.crc32(str(i).encode()) for i in shard["doc_id"]])
        shard = shard.sort_values(["turn", "doc_id"], kind="stable")
        coded = [(t or "").encode() for t in shard["text"]]
        weights = fit_ftrl(coded, shard["_llm_label"].tolist(), settings, epochs)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": used, "weight": weights[used]})

    fitted = dealt.groupBy("_llm_shard").applyInPandas(fit, "place long, weight double")
    mean = fitted.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    weights = np.zeros(2**BITS + 1)
    weights[mean["place"].to_numpy(np.int64)] = mean["weight"].to_numpy()
    return weights


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``; an empty or null text has the bias's score."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = [score(features(t.as_py() or b""), model.value) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scores, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Only the text enters a score. Null ids are scored and never held out; repeated rows are
    repeated; empty tables give an empty table.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
