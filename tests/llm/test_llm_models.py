"""HTML extraction, exact search and the quality classifier."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SMALL
from llm_frames import edge_docs, prose
from pyspark.sql import functions as F

from lodgecast.llm import crf
from lodgecast.llm.html_blocks import leaf_blocks
from lodgecast.llm.html_extract import block_features, extract_main_text, main_text, train_extractor
from lodgecast.llm.html_layouts import labelled_page
from lodgecast.llm.quality_classifier import classify, shape
from lodgecast.llm.topk_search import exact_top_k


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    "start", ["<p data-x=O'Neil>", "<p size=5\">", "<p '>", "<p a=\"x>y\" b='<z>'>", "<p href=q?a=\"b>", "<p =\">", "<p title=\"open>"]
)
def test_quotes_in_tags_take_no_text(start):
    page = f"{start}First one.</p><p>It's the second.</p><p>Third</p>"
    assert texts(page) == ["First one.", "It's the second.", "Third"]


def test_blocks_of_broken_pages():
    assert texts("") == texts("<!-- only --><script>var a = '<p>x</p>'</script><style>p{}</style>") == []
    assert texts("<p>a<p>b &amp; c<br>d</p>e") == ["a", "b & c d", "e"]
    assert texts("<div>one <b>two</b>\n\t three<ul><li>x<li>y</ul>four</div>") == ["one two three", "x", "y", "four"]
    assert texts("<title>no</title><p>&#233;&eacute;&#x1F600;&nbsp;x&copy</p>") == ["éé😀 x©"]
    assert texts("<p>1 < 2 and 3 > 2</p><p title='a>b' class=x>c</p>") == ["1 < 2 and 3 > 2", "c"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<p>cut <a href='x") == ["cut"]
    assert texts("<p>cut </") == ["cut"]
    assert texts("<script>never closed <p>x") == []
    assert texts("</p></div>x<p title=\"open quote>y</p>") == ["x", "y"]
    assert [b.link_chars for b in leaf_blocks("<p><a>ab</a> cd</p><p>ef</p>")] == [2, 0]
    assert leaf_blocks("<div class='Side-Bar x'><p>t</p></div>")[0].path == ("div side bar x", "p")


@pytest.fixture(scope="module")
def weights(spark):
    return train_extractor(spark.read.parquet(f"{SMALL}/pages.parquet"))


def test_layouts_that_were_not_trained_on(weights):
    rng, right, total = random.Random(99), 0, 0
    spare = [" ".join(prose(i, 60)) for i in range(30)]
    for _ in range(150):
        paragraphs = [" ".join(prose(rng.randint(100, 999), rng.randint(5, 80))) for _ in range(rng.randint(1, 15))]
        blocks = leaf_blocks(labelled_page(rng, paragraphs, spare))
        found = crf.viterbi(weights, block_features(blocks))
        right += sum(f == (b.label == "main") for f, b in zip(found, blocks))
        total += len(blocks)
    assert right / total > 0.95


def test_plain_page(weights):
    page = (
        "<header class=site-header><a href=/>Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies.</div><main><h1>The title</h1><p>First  text &amp; more.</p>"
        "<div class=ad>Buy now!</div><p>Second text, a bit longer than the first one.</p></main>"
        "<section id=comments><p>Nice article, I liked it.</p></section><form class=newsletter><p>Subscribe"
        "</p><button>Go</button></form><footer>&copy; 2024 somebody</footer>"
    )
    assert main_text(page, weights) == (
        "The title\nFirst text & more.\nSecond text, a bit longer than the first one."
    )


def test_extraction_of_awkward_rows(spark, weights):
    rows = [(1, "u", None, 1), (None, None, "", 2), (3, "u", "<p>", 3), (3, "u", "<article><p>A text of an article.</p></article>", 4)]
    pages = spark.createDataFrame(rows * 2, "page_id long, url string, html string, text int")
    found = extract_main_text(pages, weights).collect()
    assert len(found) == 8
    assert sorted(r.text for r in found) == [""] * 6 + ["A text of an article."] * 2
    assert all(r.n_chars == len(r.text) for r in found)
    assert extract_main_text(pages.filter(F.lit(False))).count() == 0
    assert {r.text for r in extract_main_text(pages.filter("page_id = 1")).collect()} == {""}


def test_crf_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    weights = rng.normal(0, 0.5, crf.SIZE)
    rows = [rng.integers(0, 50, 4) for _ in range(5)]
    sequence, labels = (rows, [0, 1, 0, 0, 1]), [1, 0, 0, 1, 1]

    def likelihood(w):
        start, step = crf._parts(w)
        own = crf.unary(w, rows)

        def total(path):
            steps = sum(step[k][a][b] for k, a, b in zip(sequence[1][1:], path, path[1:]))
            return start[path[0]] + steps + sum(own[i] for i, y in enumerate(path) if y)

        paths = [[n >> i & 1 for i in range(5)] for n in range(32)]
        assert crf.viterbi(w, sequence) == max(paths, key=total)
        return total(labels) - np.logaddexp.reduce([total(p) for p in paths])

    by_place, at_start, steps = crf.gradient(weights, sequence, labels)
    full = np.zeros(crf.SIZE)
    for place, row in zip(by_place, rows):
        np.add.at(full, row, place)
    full[2**crf.BITS :] = np.r_[at_start, steps.ravel()]
    for i in [*np.unique(np.concatenate(rows))[:5], *range(2**crf.BITS, crf.SIZE)]:
        moved = weights.copy()
        moved[i] += 1e-5
        assert (likelihood(moved) - likelihood(weights)) / 1e-5 == pytest.approx(full[i], abs=1e-3)


def search_by_hand(rows, k, is_query):
    usable = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable[vec_id, tuple(np.floor(1024 * np.array(v, float)).astype(int).tolist())] = True
    out = []
    for query_id, q in usable:
        if is_query(query_id) and q:
            scores = [(-int(np.dot(q, v)), i) for i, v in usable if i != query_id and len(v) == len(q)]
            out += [(query_id, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_exact_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 0.2, 8) * rng.choice([1, 4])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1_000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [rows[3], (500, None), (501, [1.0, None, *[0.0] * 6]), (502, [float("nan")] * 8)]
    rows += [(503, [float("inf")] * 8), (None, rows[0][1]), (504, []), (505, [0.0] * 8), (600, [1.0, 2.0])]
    rows += [(700, [1.0, -2.0]), (3, rows[4][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    for k, block_rows in ((10, 64), (3, 4_096), (1_000, 64)):
        found = exact_top_k(table, F.col("vec_id") % 10 == 0, k, block_rows, query_rows=16)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        got = sorted(tuple(r) for r in found.collect())
        assert got == search_by_hand(rows, k, lambda i: i % 10 == 0)
    assert exact_top_k(table.filter(F.lit(False)), F.lit(True)).count() == 0


def test_classifier_on_held_out_rows(spark):
    folder = SMALL.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs, labels)
    held = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(held) > 50
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert scored.count() == docs.count()


def test_classifier_on_awkward_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame(
        [(4, 1), (5, 1), (5, 0), (6, None), (None, 1), (7, 1), (17, 0), (17, 0), (11, 0), (99, 1)],
        "doc_id long, quality int",
    )
    found = classify(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    by_text = {}
    for r, (_, text) in zip(
        sorted(found, key=lambda r: (str(r.doc_id), r.score)), sorted(((str(d.doc_id), d.text) for d in docs.collect()))
    ):
        by_text.setdefault(text, set()).add(r.score)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1  # no words: the bias alone
    none = labels.filter(F.lit(False))
    assert {r.score for r in classify(docs, none).collect()} == {0.5}
    assert classify(docs.filter(F.lit(False)), labels).count() == 0


def test_shapes():
    assert [shape(w) for w in ("Word", "WORD!!", "a1b22%%%", "", "é")] == ["Aa", "A!", "a0a0%", "", "a"]
