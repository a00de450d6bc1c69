"""Main text of web pages: a conditional random field over the leaf blocks of the DOM.

Training pages come from a bounded sample of the given pages. Where a page marks its article, its
blocks are labelled by that; its paragraphs are also rendered into other layouts with known
roles. Shards of the sample fit a model each and the models are averaged by a group-by. The model
has a fixed size and goes to the tasks that read, decode (Viterbi) and join the blocks of every
page. Nothing is shuffled but the sample.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm import crf
from lodgecast.llm.html_blocks import Block, leaf_blocks
from lodgecast.llm.html_layouts import labelled_page

TRAIN_PAGES = 1_200  # bound on the pages the model is fitted on; every page is extracted
LAYOUTS = 4  # drawings of each training page
SHARDS = 6
LONGEST = 60  # paragraphs of a training page that are rendered


def _index(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(n.encode()) & (2**crf.BITS - 1) for n in names], np.int64)


@lru_cache(maxsize=50_000)
def _path_features(path: tuple[str, ...]) -> np.ndarray:
    names = ["bias"]
    tags = [marks.split()[0] for marks in path]
    names += [f"tag {t}" for t in dict.fromkeys(tags)]
    names += [f"name {n}" for n in dict.fromkeys(n for marks in path for n in marks.split()[1:])]
    names += [f"near {t} {i}" for i, t in enumerate(reversed(tags[-3:]))]
    return _index(names)


@lru_cache(maxsize=50_000)
def _text_features(*facts: int) -> np.ndarray:
    return _index([f"fact {i} {v}" for i, v in enumerate(facts)])


def block_features(blocks: list[Block]) -> crf.Sequence:
    """Hashed features of each block: ancestors and their names, and facts about the text.

    A block is of kind 1 if it stands in the same elements as the one before.
    """
    rows: list[np.ndarray] = []
    kinds = [int(i > 0 and blocks[i - 1].path == b.path) for i, b in enumerate(blocks)]
    for i, b in enumerate(blocks):
        size = len(b.text)
        words = b.text.count(" ") + 1
        linked = b.link_chars / size
        rows.append(
            np.concatenate(
                [
                    _path_features(b.path),
                    _text_features(
                        min(9, size.bit_length()),
                        min(6, words.bit_length()),
                        0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.8 else 3,
                        int(b.text[-1] in ".!?:;\"'”»)"),
                        int(b.text[0] in "©"),
                        int("|" in b.text or "·" in b.text or "»" in b.text),
                        kinds[i],
                    ),
                ]
            )
        )
    return rows, kinds


def _training_pages(page_id: int, page: str) -> Iterator[tuple[crf.Sequence, list[int]]]:
    """The page itself, if it marks its article, and drawings of its paragraphs."""
    blocks = leaf_blocks(page)
    marked = [any(m.split()[0] in ("article", "main") for m in b.path) for b in blocks]
    chosen = [b.text for b, m in zip(blocks, marked) if m]
    chosen = chosen or [b.text for b in blocks if len(b.text) > 80]
    if not chosen:
        return
    if any(marked):
        yield block_features(blocks), [int(m) for m in marked]
    rng = random.Random(zlib.crc32(str(page_id).encode()))
    for _ in range(LAYOUTS):
        most = rng.randint(1, LONGEST)
        drawn = leaf_blocks(labelled_page(rng, chosen[:most], chosen))
        yield block_features(drawn), [int(b.label == "main") for b in drawn]


def train_extractor(pages: DataFrame, rows: int = TRAIN_PAGES) -> np.ndarray:
    """Weights fitted on about ``rows`` pages at most, those with the smallest hashes."""
    known = pages.filter(F.col("html").isNotNull())
    total, span = known.count(), 1 << 30
    hashed = F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.length("html"))
    drawn = known.filter(F.pmod(hashed, F.lit(span)) < int(span * min(1.0, rows / max(1, total))))
    dealt = drawn.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"),
        "html",
        F.pmod(F.xxhash64("page_id", F.lit(1)), F.lit(SHARDS)).alias("_llm_shard"),
    )

    def fit(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["page_id", "html"], kind="stable")
        examples = [x for i, h in zip(shard["page_id"], shard["html"]) for x in _training_pages(i, h)]
        random.Random(5).shuffle(examples)
        weights = crf.fit(examples)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"place": used, "weight": weights[used], "fitted": bool(examples)})

    fitted = dealt.groupBy("_llm_shard").applyInPandas(
        fit, "place long, weight double, fitted boolean"
    )
    # At most crf.SIZE weights come back, however many pages there are.
    mean = fitted.groupBy("place").agg((F.sum("weight") / SHARDS).alias("weight")).toPandas()
    weights = np.zeros(crf.SIZE)
    weights[mean["place"].to_numpy(np.int64)] = mean["weight"].to_numpy()
    return weights


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = leaf_blocks(page or "")
    labels = crf.viterbi(weights, block_features(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels) if label)


def extract_main_text(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null or empty html, and pages without a block of main text, give an empty text. Null ids and
    urls, repeated rows and extra columns make no difference. Without any page to train on, all
    weights are 0 and no block is main text.
    """
    if weights is None:
        weights = train_extractor(pages)
    model = pages.sparkSession.sparkContext.broadcast(weights)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), model.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )
