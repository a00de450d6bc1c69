"""Ranked lexical search over bags: documents reduced to the items' terms, equal ones scored once.

Only terms of the items can change a score, so a document becomes the counts of those terms. With
its length class m they decide every score; documents that agree in both (found by hash, told
apart by the counts themselves) form a class. A class is scored once for all items and stands in
for its members, of which an item's first k can only use the k smallest ids. At the end the best
classes of an item are expanded again.

Items are taken in blocks of bounded vocabulary, each against all documents; a block's terms are
the only thing sent to all tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.common import whole_text
from lodgecast.plans.numbering import running_total
from lodgecast.plans.storage import small_frame, stored

TOP = 50
BLOCK_TERMS = 200_000  # terms of all items of a block, repeats between items counted
_CELLS = 2_000_000  # class by item scores held at a time
_TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8 every byte of a wider character is above 7F
_DOCUMENTS, _LENGTH = -1, -2  # stand in for terms where totals are counted
_LOW = 20  # bits; scores are summed in two parts so that sums of doubles stay exact


def terms(text: bytes) -> list[bytes]:
    """Terms in order, A-Z in lower case."""
    return _TERMS.findall(text.lower())


def _item_terms(items: DataFrame) -> DataFrame:
    """``_llm_item, item_id, terms``: each row of ``items`` that has terms, with its distinct ones."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t.as_py()))) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))],
                ["_llm_item", "item_id", "terms"],
            )

    rows = items.select(
        F.monotonically_increasing_id().alias("_llm_item"), "item_id", whole_text().alias("text")
    )
    split_rows = rows.mapInArrow(split, f"_llm_item long, item_id {kind}, terms array<binary>")
    return stored(split_rows.filter(F.size("terms") > 0), "items")


def _blocks(items: DataFrame, block_terms: int) -> Iterator[DataFrame]:
    """The items in blocks of about ``block_terms`` terms; one with more is alone or nearly so."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    if total <= block_terms:
        yield items
        return
    sized = running_total(items.withColumn("_llm_size", F.size("terms")), "_llm_item", "_llm_size", "_llm_sum")
    dealt = stored(sized.withColumn("_llm_block", F.expr(f"_llm_sum div {block_terms}")), "item-blocks")
    for block in range(-(-total // block_terms)):
        yield dealt.filter(F.col("_llm_block") == block)


class _Queries:
    """A block's items over its vocabulary: which items hold a term."""

    def __init__(self, items: list[int], found: list[list[bytes]]) -> None:
        self.names = np.array(items, np.int64)
        self.terms = {t: k for k, t in enumerate(sorted(set().union(*found)))}
        self.items = len(found)
        ids = np.array([self.terms[t] for f in found for t in f], np.int64)
        item = np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(ids, kind="stable")
        self.holders = item[order]
        self.counts = np.bincount(ids, minlength=len(self.terms))
        self.first = np.cumsum(self.counts) - self.counts


def _bags(docs: DataFrame, known) -> DataFrame:
    """``_llm_row, doc_id, n, bag`` of the documents that have terms.

    ``bag`` has the numbers of the document's terms that items use, ascending, then their counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            sizes, bags = [], []
            for text in batch.column(1).cast(pa.binary()):
                own = terms(text.as_py())
                sizes.append(len(own))
                tf = Counter(map(number, own))
                tf.pop(None, None)
                bag = np.array(sorted(tf.items()), np.int32).reshape(-1, 2)
                bags.append(bag.T.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())],
                ["doc_id", "n", "bag"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    bags = narrow.mapInArrow(count, "doc_id long, n long, bag binary").filter("n > 0")
    return stored(bags.withColumn("_llm_row", F.monotonically_increasing_id()), "bags")


def _statistics(bags: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms, and for each of the block's terms the documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            documents += batch.num_rows
            length += sum(batch.column(0).to_pylist())
            for bag in batch.column(1):
                found = np.frombuffer(bag.as_py(), np.int32)
                holding[found[: len(found) // 2]] += 1
        used = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[_DOCUMENTS, _LENGTH, used]), pa.array(np.r_[documents, length, holding[used]])],
            ["term", "found"],
        )

    counted = bags.select("n", "bag").mapInArrow(count, "term long, found long")
    totals = {r["term"]: r["found"] for r in counted.groupBy("term").agg(F.sum("found").alias("found")).collect()}
    holding = np.array([totals.get(t, 0) for t in range(vocabulary)], np.int64)
    return totals.get(_DOCUMENTS, 0), totals.get(_LENGTH, 0), holding


def term_weights(documents: int, holding: np.ndarray) -> np.ndarray:
    """A term's weight, from how many of the documents hold it."""
    ratios = ((2 * documents + 2) / (2 * h + 1) for h in holding.tolist())
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _classes(bags: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """``class, member, doc_id, m, bag``: each class's rows of the ``top`` smallest ids.

    A class is named by its first row, which alone keeps ``bag``. Rows are dealt by hash, the
    window compares counts and m themselves. A class of any size sends ``top`` rows a task.
    """
    length_class = F.expr(f"50 + (50 * n * {documents}L) div {max(length, 1)}L").alias("m")
    keyed = bags.filter(F.length("bag") > 0).select(
        F.xxhash64("bag").alias("_llm_hash"), "bag", length_class, "doc_id", "_llm_row"
    )
    same = Window.partitionBy("_llm_hash", "m", "bag").orderBy(F.asc_nulls_last("doc_id"), "_llm_row")
    so_far = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = keyed.select(
        F.first("_llm_row").over(so_far).alias("class"),
        F.row_number().over(same).alias("member"),
        "doc_id",
        "m",
        "bag",
    ).filter(F.col("member") <= top)
    return stored(members.withColumn("bag", F.when(F.col("member") == 1, F.col("bag"))), "bag-classes")


class _Best:
    """The best classes of each item so far."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.kept = np.zeros((4, 0), np.int64)  # item, score, class, smallest id

    def add(self, scores: np.ndarray, classes: np.ndarray, smallest: np.ndarray) -> None:
        """``scores`` by class and item."""
        least = np.ones(scores.shape[1], np.int64)
        if len(scores) > self.top:
            least = np.maximum(least, -np.partition(-scores, self.top - 1, axis=0)[self.top - 1])
        row, item = np.nonzero(scores >= least)
        found = np.stack([item, scores[row, item], classes[row], smallest[row]])
        found = np.concatenate([self.kept, found], axis=1)
        found = found[:, np.lexsort((found[2], found[3], -found[1], found[0]))]
        begin = np.searchsorted(found[0], found[0])
        self.kept = found[:, np.arange(found.shape[1]) - begin < self.top]


_NO_ID = 2**63 - 1


def _score(classes: DataFrame, queries, weights, top: int) -> DataFrame:
    """``_llm_item, score, class, smallest``: the best classes of each task for each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, w, best = queries.value, weights.value, _Best(top)
        at_once = max(1, _CELLS // q.items)
        for batch in batches:
            for first in range(0, batch.num_rows, at_once):
                part = batch.slice(first, at_once)
                bags = [np.frombuffer(b.as_py(), np.int32) for b in part.column(3)]
                sizes = np.array([len(b) // 2 for b in bags])
                term = np.concatenate([b[: len(b) // 2] for b in bags]).astype(np.int64)
                tf = np.concatenate([b[len(b) // 2 :] for b in bags]).astype(np.int64)
                row = np.repeat(np.arange(len(bags)), sizes)
                m = part.column(2).to_numpy()[row]
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                # Every (term of a class) meets the items that hold the term.
                times = q.counts[term]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cell = np.repeat(row, times) * q.items + q.holders[np.repeat(q.first[term], times) + nth]
                value = np.repeat(value, times)
                cells = len(bags) * q.items
                high = np.bincount(cell, value >> _LOW, cells).astype(np.int64)
                low = np.bincount(cell, value & ((1 << _LOW) - 1), cells).astype(np.int64)
                scores = ((high << _LOW) + low).reshape(len(bags), q.items)
                best.add(scores, part.column(0).to_numpy(), part.column(1).to_numpy())
        columns = [q.names[best.kept[0]], *best.kept[1:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["_llm_item", "score", "class", "smallest"]
        )

    rows = classes.filter("member = 1").select(
        "class", F.coalesce("doc_id", F.lit(_NO_ID)).alias("smallest"), "m", "bag"
    )
    return rows.mapInArrow(score, "_llm_item long, score long, class long, smallest long")


def rank_documents(
    items: DataFrame, docs: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents.

    Null and empty texts have no terms: such documents count nowhere, such items get no rows.
    Equal scores go by ascending doc_id, null last; every row is a document, so repeated rows
    share a score and have ranks of their own. Every row of ``items`` is an item, also with a
    repeated or null item_id. Texts of any length are read whole. Empty tables give an empty
    result. ``docs`` is read once per block of items; give a scan or a stored frame.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    ranked = None
    for block in _blocks(_item_terms(items), block_terms):
        rows = block.select("_llm_item", "terms").collect()  # about block_terms terms, or one item
        if not rows:
            continue
        queries = _Queries([r["_llm_item"] for r in rows], [[bytes(t) for t in r["terms"]] for r in rows])
        sent = spark.sparkContext.broadcast(queries)
        bags = _bags(docs, spark.sparkContext.broadcast(queries.terms))
        documents, length, holding = _statistics(bags, len(queries.terms))
        weights = spark.sparkContext.broadcast(term_weights(documents, holding))
        classes = _classes(bags, documents, length, top)
        by_item = Window.partitionBy("_llm_item").orderBy(F.desc("score"), "smallest", "class")
        leading = _score(classes, sent, weights, top)
        leading = leading.withColumn("_llm_nth", F.row_number().over(by_item)).filter(F.col("_llm_nth") <= top)
        expanded = leading.select("_llm_item", "score", "class").join(classes.select("class", "member", "doc_id"), "class")
        by_score = Window.partitionBy("_llm_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "class", "member")
        best = expanded.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= top)
        named = best.join(block.select("_llm_item", "item_id"), "_llm_item")
        named = named.select("item_id", "rank", "doc_id", "score")
        ranked = named if ranked is None else ranked.unionByName(named)
    if ranked is None:
        return small_frame(spark, [(None, 0, 0, 0)], f"item_id {kind}, rank int, doc_id long, score long").limit(0)
    return ranked


def rank_report(items: DataFrame, docs: DataFrame) -> DataFrame:
    return rank_documents(items.select("item_id", "text"), docs.select("doc_id", "text"))
