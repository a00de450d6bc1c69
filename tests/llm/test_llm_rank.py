"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from llm_frames import documents, edge_docs, edge_rows, prose

from lodgecast.llm.lexical_rank import rank_documents, rank_report, term_weights, terms

LOW = {k: k + 32 for k in range(65, 91)}


def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def ranked_by_hand(items, docs, top):
    bags = [(doc_id, Counter(terms_by_hand(text))) for doc_id, text in docs]
    bags = [(doc_id, bag, sum(bag.values())) for doc_id, bag in bags if bag]
    count, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    rows = []
    for item_id, text in items:
        found = []
        for doc_id, bag, n in bags:
            m = 50 + 50 * n * count // length
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
                for t in set(terms_by_hand(text)) & set(bag)
            )
            if score:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, missing, doc_id) in enumerate(sorted(found)[:top], 1):
            rows.append((item_id, rank, None if missing else doc_id, -score))
    return sorted(rows, key=repr)


def items_and_docs(spark):
    rows = [*edge_rows(), *[(100 + k, " ".join(prose(k % 7, 30 + k % 3)), "en", "a") for k in range(60)]]
    docs = edge_docs(spark, rows)
    items = [
        (1, "Only two"),
        (2, " ".join(prose(1, 40))),
        (3, None),
        (4, " ,;- "),
        (2, " ".join(prose(3, 25))),
        (None, "é ünïcode 𝒳😀 only"),
        (5, "nothing has thesewords"),
        (6, "und und line that"),
        (6, "und und line that"),
    ]
    frame = spark.createDataFrame([(*r, 7, "x") for r in items], "item_id int, text string, doc_id int, lang string")
    return items, frame, docs


@pytest.mark.parametrize("top, block_terms", [(50, 200_000), (3, 200_000), (2, 10)])
def test_rank(spark, top, block_terms):
    items, frame, docs = items_and_docs(spark)
    found = rank_documents(frame, docs, top, block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    expected = ranked_by_hand(items, documents(docs), top)
    assert expected and sorted((tuple(r) for r in found.collect()), key=repr) == expected


def test_empty_tables(spark):
    _, frame, docs = items_and_docs(spark)
    assert rank_report(frame.limit(0), docs).count() == 0
    assert rank_report(frame, docs.limit(0)).count() == 0


def test_terms_and_weights():
    for seed in range(50):
        text = "".join(random.Random(seed).choices("aZ09 _-\x7f\x80éß中😀\n\x00[`{", k=80))
        assert [t.decode() for t in terms(text.encode())] == terms_by_hand(text)
    import numpy as np

    assert term_weights(3, np.array([0, 3])).tolist() == [math.floor(1000 * math.log(8)), math.floor(1000 * math.log(8 / 7))]
