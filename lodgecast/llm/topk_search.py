"""Exact top-k search with an impact-ordered, score-at-a-time index.

Vectors are dealt to blocks by hash. A block's index has, per dimension, its postings in order of
value, cut into segments of equal quantised impact. A query adds segments to its accumulators in
descending order of the impact they can have, over all dimensions together. From time to time
every vector's score is bounded: what was added is known to a quantisation step, and what is
still to come in a dimension lies below that dimension's next segment. The query stops once the
bounds prove all but a few vectors out of its top k, and those few are scored exactly. A block
where no such proof comes is processed to its last segment, so the result is always exact.

Index blocks and blocks of queries meet pairwise (a query set against all rows, in blocks); per
query only k rows of each block are shuffled, and Spark's window limit trims them again before
the final ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.plans.storage import stored

SCALE = 1024
STEP = 32  # width of a quantised impact in units of the scaled components
BLOCK_ROWS, QUERY_ROWS = 8_192, 1_024  # vectors of an index block, queries of a query block
SHARES = (0.6, 0.85, 1.0)  # of the postings, where a proof is tried
RESCORED = 1 / 32  # a proof is good enough once this share of a block is left to rescore


def scaled_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id, _llm_vector`` (whole numbers floor(1024 x)) of the vectors that take part.

    Left out: vectors that are null or hold null or non-finite components, and rows without
    ``vec_id``, which a result could not name. Rows equal in id and vector count once.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        embeddings.select("vec_id", x.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE)).alias("_llm_vector"))
        .dropDuplicates(["vec_id", "_llm_vector"])
        .withColumn("_llm_dims", F.size("_llm_vector"))
    )


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: ids, vectors and per dimension the positions by descending value."""

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("vec_id", kind="stable")
        matrix = np.stack(block["_llm_vector"].to_numpy()).astype(np.int64)
        order = np.argsort(-matrix, axis=0, kind="stable").astype(np.int32)
        return pd.DataFrame(
            {
                "_llm_dims": [matrix.shape[1]],
                "_llm_block": block["_llm_block"].iloc[:1].to_numpy(),
                "ids": [block["vec_id"].to_numpy(np.int64).tobytes()],
                "matrix": [matrix.tobytes()],
                "order": [np.ascontiguousarray(order.T).tobytes()],
            }
        )

    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.filter(F.col("_llm_dims") > 0).withColumn(
        "_llm_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    )
    return dealt.groupBy("_llm_dims", "_llm_block").applyInPandas(
        build, "_llm_dims int, _llm_block long, ids binary, matrix binary, `order` binary"
    )


@dataclass
class _Block:
    """An index block in a task, with the segments of each dimension."""

    ids: np.ndarray
    matrix: np.ndarray
    quantised: np.ndarray
    order: np.ndarray
    dims: np.ndarray  # of each segment
    levels: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def load(row: pd.Series) -> _Block:
        ids = np.frombuffer(row["ids"], np.int64)
        matrix = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), -1)
        order = np.frombuffer(row["order"], np.int32).reshape(-1, len(ids)).astype(np.intp)
        quantised = matrix // STEP
        if np.abs(quantised).max(initial=0) < 2**15:
            quantised = quantised.astype(np.int16)
        dims, levels, starts, ends = [], [], [], []
        for d in range(matrix.shape[1]):
            level = quantised[order[d], d]  # descending
            first = np.flatnonzero(np.r_[True, level[1:] != level[:-1]])
            dims.append(np.full(len(first), d))
            levels.append(level[first].astype(np.int64))
            starts.append(first)
            ends.append(np.r_[first[1:], len(level)])
        parts = map(np.concatenate, (dims, levels, starts, ends))
        return _Block(ids, matrix, quantised, order, *parts)


def search_block(block: _Block, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's best ``k`` for one query, its own id left out."""
    others = block.ids != query_id
    if others.sum() <= k:
        possible = np.flatnonzero(others)
    else:
        possible = _possible(block, query, others, k)
    scores = block.matrix[possible] @ query
    best = np.lexsort((block.ids[possible], -scores))[:k]
    return block.ids[possible][best], scores[best]


def _possible(block: _Block, query: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """Places of vectors that the processed segments do not prove out of the best ``k``."""
    weight = query[block.dims]
    low, high = weight * block.levels * STEP, weight * (block.levels * STEP + STEP - 1)
    most, least = np.maximum(low, high), np.minimum(low, high)
    turn = np.argsort(-most, kind="stable")
    turn = turn[weight[turn] != 0]  # a component of 0 adds nothing to any score
    postings = np.cumsum((block.ends - block.starts)[turn])
    n, width = block.matrix.shape
    slack = np.abs(query) * float(STEP - 1)
    lowest = np.full(width, np.inf)
    np.minimum.at(lowest, block.dims, least)
    kind = block.quantised.dtype
    sign = np.where(query < 0, -1, 1).astype(kind)
    falling = block.quantised * sign  # levels, such that segments come in falling order
    added, done = np.zeros(n), 0
    possible = np.flatnonzero(others)
    if not len(turn):
        return possible
    for share in SHARES:
        upto = len(turn) if share == 1.0 else int(np.searchsorted(postings, share * postings[-1]))
        chosen, done = turn[done:upto], max(done, upto)
        if len(chosen):
            lists = [block.order[block.dims[s], block.starts[s] : block.ends[s]] for s in chosen]
            impacts = np.repeat(most[chosen].astype(float), [len(x) for x in lists])
            added += np.bincount(np.concatenate(lists), impacts, n)
        # The next segment of each dimension bounds what vectors not met there can still add.
        ahead, first = np.unique(block.dims[turn[done:]], return_index=True)
        bounds = np.zeros((width, 2), np.float32)
        limit = np.full(width, np.iinfo(kind).min, kind)  # nothing is unseen in a finished one
        if len(ahead):
            nearest = turn[done:][first]
            limit[ahead] = block.levels[nearest] * sign[ahead]
            bounds[ahead, 0] = most[nearest]
            bounds[ahead, 1] = (slack + lowest)[ahead]
        more = (falling <= limit).astype(np.float32) @ bounds
        margin = 1.0 + 1e-5 * float(np.abs(bounds).sum())  # for the sums in single precision
        upper, lower = added + more[:, 0], added - slack.sum() + more[:, 1]
        bar = np.partition(lower[others], -k)[-k]
        possible = np.flatnonzero(others & (upper >= bar - margin))
        if len(possible) <= max(2 * k, RESCORED * n):
            break
    return possible


def exact_top_k(
    embeddings: DataFrame,
    is_query: Column,
    k: int = 10,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query.

    Queries are the rows where ``is_query`` holds; candidates are all rows but those with the
    query's id. Ties go to the smaller ``vec_id``; a query with fewer than ``k`` candidates gets
    all. Only vectors of the query's length are comparable to it; empty vectors are not searched.
    An id with two different vectors is two candidates, and two queries of one name. Empty tables
    give empty results.
    """
    vectors = stored(scaled_vectors(embeddings), "search-vectors")
    index = stored(build_index(vectors, block_rows), "search-index")
    queries = vectors.filter(is_query & (F.col("_llm_dims") > 0))
    parts = max(1, -(-queries.count() // query_rows))
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(parts))
    blocks = index.select(
        F.col("_llm_dims").alias("_llm_at_dims"), F.col("_llm_block").alias("_llm_at_block")
    )
    asked = queries.select(
        "_llm_dims",
        F.col("vec_id").alias("query_id"),
        F.col("_llm_vector").alias("query"),
        part.alias("_llm_at_part"),
        F.xxhash64("vec_id", "_llm_vector").alias("_llm_query"),
    ).join(blocks, F.col("_llm_dims") == F.col("_llm_at_dims"))
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    offered = index.withColumn("_llm_part", every_part)

    def search(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int]] = []
        if len(block) and len(asked):
            loaded = _Block.load(block.iloc[0])
            for query_id, key, query in zip(asked["query_id"], asked["_llm_query"], asked["query"]):
                ids, scores = search_block(loaded, query_id, np.asarray(query, np.int64), k)
                found += [(query_id, key, int(i), int(s)) for i, s in zip(ids, scores)]
        return pd.DataFrame(found, columns=["query_id", "_llm_query", "vec_id", "score"])

    found = (
        offered.groupBy("_llm_dims", "_llm_block", "_llm_part")
        .cogroup(asked.groupBy("_llm_at_dims", "_llm_at_block", "_llm_at_part"))
        .applyInPandas(search, "query_id long, _llm_query long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id", "_llm_query").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("query_id"), "rank", "vec_id", "score")
    )
