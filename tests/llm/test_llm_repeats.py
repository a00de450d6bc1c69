"""Suffix intervals, repeat dedup, common extensions and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_frames import documents, edge_docs, edge_rows, prose

from lodgecast.llm.cover_lce import COVER, MODULUS, CoverLce
from lodgecast.llm.periodic_runs import collapse_runs, find_runs, periodic_runs, planted, run_report
from lodgecast.llm.repeat_dedup import SHARD_BYTES, drop_repeats, repeat_report, segments
from lodgecast.llm.suffix_intervals import SuffixIntervals


def test_a_shard_is_sorted_in_bounded_memory():
    rng = random.Random(5)
    passage = rng.randbytes(700)
    count = SHARD_BYTES // 700
    texts = [rng.randbytes(k % 90) + passage[: 700 - k % 90] for k in range(count)]
    tracemalloc.start()
    index = SuffixIntervals(texts, np.full(count, 301), 400, np.zeros(count, bool))
    assert len(index.covered()[0]) == count
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # two workers and the JVM share an executor's memory


def spans_by_hand(texts: list[bytes], window: int) -> list[list[tuple[int, int]]]:
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        edges = [i for i in range(len(t) + 1) if (i > 0 and gone[i - 1]) != (i < len(t) and gone[i])]
        out.append(list(zip(edges[::2], edges[1::2])))
    return out


def repeats_by_hand(texts: list[bytes], least: int) -> dict[bytes, list[tuple[int, int]]]:
    """Strings found twice or more that lose an occurrence when extended to either side."""
    places = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                places[t[i:j]].append((k, i))
    out = {}
    for text, found in places.items():
        left = {texts[k][i - 1] if i else (k, "start") for k, i in found}
        right = {texts[k][i + len(text)] if i + len(text) < len(texts[k]) else (k, "end") for k, i in found}
        if len(found) > 1 and len(left) > 1 and len(right) > 1:
            out[text] = sorted(found)
    return out


def letters(seed: int, size: int, kinds: int = 3) -> bytes:
    return bytes(random.Random(seed).choices(range(97, 97 + kinds), k=size))


@pytest.mark.parametrize("seed", range(12))
def test_maximal_repeats(seed):
    rng = random.Random(seed)
    shared = letters(900 + seed, rng.randint(8, 40))
    texts = [
        letters(seed * 10 + k, rng.randint(8, 60), rng.choice((1, 2, 4))) + shared * rng.randint(0, 2) + letters(seed + k, 9)
        for k in range(4)
    ]
    texts.append(texts[0])
    index = SuffixIntervals(
        texts, np.array([max(0, len(t) - 7) for t in texts]), 8, np.array([False, True, False, False, False])
    )
    found = {}
    for length, i, j in index.groups():
        places = []
        for at in index.order[i : j + 1].tolist():
            k = int(np.searchsorted(index.first, at, "right")) - 1
            places.append((k, at - int(index.first[k])))
        k, at = places[0]
        found[texts[k][at : at + length]] = sorted(places)
    # The copies of text 1 are 1 and 5 here; occurrences in it stand for all of them.
    by_hand = repeats_by_hand([*texts, texts[1]], 8)
    assert found == {t: [p for p in places if p[0] != 5] for t, places in by_hand.items()}
    covered = sorted(zip(*(x.tolist() for x in index.covered())))
    spans = spans_by_hand([*texts, texts[1]], 8)[:-1]
    assert covered == [(k, a, b) for k, own in enumerate(spans) for a, b in own]


def test_segments_follow_from_windows():
    """Every window is in one segment, and equal windows have equal keys, whatever is around them."""
    texts = [b"", letters(1, 300, 4) + letters(2, 90, 4), letters(3, 50, 4) + letters(2, 90, 4), b"short", b"a" * 70, b"xyz" * 50]
    for width in (13, 4, 1):
        keys, seen = defaultdict(set), Counter()
        for k, key, first, starts, places, content in segments(texts, width, 20, 8):
            assert content == texts[k][first : first + starts + 19]
            assert places == 1 or width == 13 and starts >= places
            for i in range(first, first + starts):
                seen[k, i] += 1
                keys[texts[k][i : i + 20]].add(key)
        assert seen == {(k, i): 1 for k, t in enumerate(texts) for i in range(len(t) - 19)}
        assert all(len(v) == 1 for v in keys.values())


def result_by_hand(docs, window):
    texts = [(t or "").encode() for _, t in docs]
    rows = []
    for (doc_id, _), text, spans in zip(docs, texts, spans_by_hand(texts, window)):
        kept, at = b"", 0
        for a, b in [*spans, (len(text), len(text))]:
            kept, at = kept + text[at:a], b
        rows.append((doc_id, len(text), len(text) - len(kept), len(spans), kept))
    return sorted(rows, key=repr)


def test_repeat_dedup_edges(spark):
    docs = edge_docs(spark)
    found = drop_repeats(docs, 60, 16)
    assert sorted(((*r[:4], bytes(r[4])) for r in found.collect()), key=repr) == result_by_hand(documents(docs), 60)
    assert drop_repeats(docs.limit(0)).count() == 0
    report = sorted((tuple(r) for r in repeat_report(docs).collect()), key=repr)
    by_hand = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in result_by_hand(documents(docs), 400)]
    assert report == sorted(by_hand, key=repr)


@pytest.mark.parametrize("hot, shard_bytes", [(2048, 3 << 20), (3, 500), (1, 1)])
def test_hot_passage(spark, hot, shard_bytes):
    """Very many documents hold one passage in different surroundings; some surroundings repeat."""
    passage = " ".join(prose(7, 6))
    rows = [(k, " ".join([*prose(100 + k % 25, 6), passage, *prose(200 + k % 40, 6)]), "en", "a") for k in range(120)]
    rows += [(500 + k, " ".join(prose(300 + k, 30)), "en", "a") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = drop_repeats(docs, 24, 8, (17, 4, 1), hot, shard_bytes)
    assert sorted(((*r[:4], bytes(r[4])) for r in found.collect()), key=repr) == result_by_hand(documents(docs), 24)


# -- periodic runs ---------------------------------------------------------------------------------


def test_cover_reaches_every_difference():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


@pytest.mark.parametrize("symbols", [[], [0], [0, 0], [0] * 90, [0, 1] * 60, [0, 1, 2] * 20 + [1] * 35])
def test_common_extensions(symbols):
    size = len(symbols)
    pairs = [(i, j) for i in range(size + 1) for j in range(size + 1) if i != j]
    found = CoverLce(np.array(symbols, np.int64)).lce(*np.array(pairs, np.int64).reshape(-1, 2).T)

    def by_hand(i, j):
        n = 0
        while max(i, j) + n < size and symbols[i + n] == symbols[j + n]:
            n += 1
        return n

    assert found.tolist() == [by_hand(i, j) for i, j in pairs]


def runs_by_hand(words) -> list[tuple[int, int, int]]:
    numbers, found = {}, {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    for q in range(1, len(words) // 4 + 1):
        same = np.r_[False, coded[q:] == coded[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
        for i, j in zip(edges[::2], edges[1::2]):
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def test_runs():
    rng = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.choice((0, 1, 5, 6, 7, 30, 150)), rng.choice((1, 2, 3, 50))
            words = [rng.randrange(kinds) for _ in range(n)]
            if n > 10 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, (n - a) // 4 + 1)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            texts.append(words)
        found = find_runs([np.array(t, np.int64) for t in texts])
        assert [sorted(zip(*(x.tolist() for x in r))) for r in found] == [runs_by_hand(t) for t in texts]


def collapsed_by_hand(docs, rewrite):
    out = []
    for doc_id, text in docs:
        words = rewrite(doc_id, (text or "").encode().split())
        runs = runs_by_hand(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        milli = 1000 * best[1] // best[2] if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out.append((doc_id, len(runs), *best, milli, lines, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def test_collapse(spark):
    rows = [*edge_rows(), *[(900 + k, " ".join(prose(k, 20 + 9 * k)), "en", "a") for k in range(40)]]
    docs = edge_docs(spark, rows)
    for rewrite in (None, planted):
        expected = collapsed_by_hand(documents(docs), rewrite or (lambda _, words: words))
        assert sorted((tuple(r) for r in collapse_runs(docs, rewrite).collect()), key=repr) == expected
        listed = sorted((r.doc_id, f"{r.start},{r.length},{r.period}\n") for r in periodic_runs(docs, rewrite).collect())
        assert listed == sorted((r[0], line) for r in expected for line in r[6].splitlines(True))
    assert sum(r[1] for r in expected) > 3
    digests = {(r.doc_id, r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in run_report(docs).collect()}
    assert digests == {(r[0], r[1], *[hashlib.sha256(x.encode()).hexdigest() for x in r[6:]]) for r in expected}
    assert collapse_runs(docs.limit(0)).count() == 0 and periodic_runs(docs.limit(0)).count() == 0


def test_planted():
    for doc_id in range(200):
        words = [str(k).encode() for k in range(1, 2 + doc_id)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        expected = [words[a + (i - a) % p] if h % 10 == 0 and i >= a else words[i] for i in range(n)]
        assert planted(doc_id, words) == expected
