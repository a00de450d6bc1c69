"""Jaccard join, components and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_frames import documents, edge_docs, edge_rows, prose
from pyspark.sql import functions as F
from test_llm_text import LOW, words

from lodgecast.llm import components as contraction
from lodgecast.llm import jaccard_join as jj
from lodgecast.llm.components import components
from lodgecast.llm.fm_index import FmIndex
from lodgecast.llm.substring_dedup import drop_repeated_windows, substring_report
from lodgecast.plans.storage import stored
from lodgecast.session import scratch_noted


def related_rows(count: int = 40) -> list[tuple]:
    """Families of texts at all distances, around and below the threshold."""
    rng, rows = random.Random(4), []
    for family in range(4):
        text = prose(50 + family, 150)
        for member in range(count // 4):
            changed = list(text)
            for place in rng.sample(range(150), rng.choice((0, 1, 2, 3, 4, 5, 8))):
                changed[place] = f"new{rng.randint(0, 3)}"
            rows.append((200 + 10 * member + family, " ".join(changed), "en", "a"))
    return rows


def shingles(text):
    own = words((text or "").translate(LOW))
    return {tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))} if own else set()


def groups_by_hand(docs):
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and group[i] != group[j]:
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[k][0] for k in range(len(docs)) if group[k] == group[i] and docs[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_shingle_hashes_leave_nothing_in_the_worker():
    jj.shingle_set(b"one two three four five")
    tracemalloc.start()
    for k in range(20):
        assert len(jj.shingle_set(" ".join(f"w{k}x{j}" for j in range(1_000)).encode())) == 997
    left, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert left < 500_000  # 20,000 words


def test_word_hashes_tell_words_apart_wherever_they_stand():
    """Words around the ends of pieces, longer than a piece, of zero bytes; A-Z as small letters."""
    rng, first = random.Random(3), {}
    odd = [b"\x00", b"\x00\x00", b"a\x00", b"\x00a", b"\xff", b"\x08", b"\x0e", "\u00e9\u00c9".encode()]
    odd += [b"ab", b"ba", b"AB", b"x" * 70_000, b"x" * 70_001, b"y" + b"x" * 140_000]
    odd += [f"w{k}".encode() for k in range(20_000)]
    for _ in range(20):
        chosen = rng.choices(odd, k=30_000) if rng.random() < 0.5 else rng.sample(odd, 12_000)
        text = b"".join(w + rng.choice((b" ", b"\n", b" \t\r", b"\x0b\x0c")) for w in chosen)
        text = rng.choice((b"", b" ", b"\n\n")) + text.rstrip() * rng.choice((0, 1))
        split = text.lower().split()
        hashes = jj.word_hashes(text).tolist()
        assert len(hashes) == len(split)
        assert all(first.setdefault(w, h) == h for w, h in zip(split, hashes))
    assert len(set(first.values())) == len(first) > 10_000


def test_a_block_is_linked_without_pandas():
    """A block has a few sets as a rule, so a frame per block takes longer than its links."""
    sets = [np.arange(n, dtype=np.uint64).tobytes() for n in (100, 99, 50, 100)]
    block = pa.table(
        {
            "candidate": [7] * 5,
            "block": [0] * 5,
            "set_key": [4, 3, 9, 1, 4],
            "tokens": [sets[0], sets[1], sets[2], sets[3], sets[0]],
            "label": [4, 3, 9, 1, 4],
            "probe": [False, True, True, False, True],
        }
    )
    assert jj._block_links(block).to_pylist() == [{"candidate": 7, "a": a, "b": 1} for a in (3, 4)]


@pytest.mark.parametrize("block_sets", [256, 3])
def test_jaccard_join(spark, monkeypatch, block_sets):
    docs = edge_docs(spark, [*edge_rows(), *related_rows()])
    if block_sets != 256:
        whole = jj.set_labels
        monkeypatch.setattr(jj, "set_labels", lambda d, p, l: whole(d, p, l, block_sets))
    found = sorted((tuple(r) for r in jj.near_duplicate_report(docs).collect()), key=repr)
    by_hand = groups_by_hand(documents(docs))
    assert found == by_hand
    assert len({r[2] for r in by_hand}) < len(by_hand) - 10


def test_blocks_meet_in_rounds_of_bounded_size(spark, monkeypatch):
    """Asking sets of a large group meet all its blocks; not all of that lies on disk at once."""
    texts = {i: " ".join(prose(50 + i, 60)) for i in range(60)}
    texts |= {100 + i: f"{texts[i]} end" for i in range(0, 60, 7)}
    docs = stored(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    whole, join, sent = jj.set_labels, jj._join_blocks, []

    def counted(blocks):
        sent.append(blocks.count())
        return join(blocks)

    monkeypatch.setattr(jj, "candidate_groups", lambda p: p.select("set_key", F.lit(1).cast("long").alias("candidate")))
    monkeypatch.setattr(jj, "set_labels", lambda d, p, l: whole(d, p, l, 3))
    monkeypatch.setattr(jj, "_join_blocks", counted)
    monkeypatch.setattr(jj, "ROUND_SETS", 0, raising=False)
    found = sorted((r.doc_id, r.component_id) for r in jj.near_duplicate_report(docs).collect())
    assert found == sorted((r[0], r[2]) for r in groups_by_hand(documents(docs)))
    assert len({c for _, c in found}) < len(found)
    between = sent[1:]  # the first call is inside the blocks
    assert sum(between) > 8 * len(texts) and max(between) <= 4 * len(texts)


def test_intermediates_go_when_they_are_used(spark):
    import os

    docs = edge_docs(spark, related_rows())
    with scratch_noted() as written:
        found = jj.near_duplicates(docs)
        assert found.count() == docs.count()
    left = [p for p in written if os.path.exists(p)]
    assert sorted(os.path.basename(p).rsplit("-", 1)[0] for p in left) == ["set-groups", "smallest"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_one_per_group(spark):
    docs = edge_docs(spark, [*edge_rows(), *related_rows()])
    kept = jj.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    worded = {r[2] for r in groups_by_hand(documents(docs)) if r[1] and r[2] is not None}
    empty = [1, 2, 3, 5]  # and the second text of 5, alone in its group
    assert sorted(i for i in ids if i is not None) == sorted([*worded, *empty])
    assert ids.count(None) == 1  # the unnumbered copy of 5 goes, the other stays


def test_prefix_filter_never_loses_a_link():
    """Linked sets share as many prefix tokens as the filter asks for, whatever the order."""
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 120)
        base = rng.sample(range(10_000), size)
        other = [x for x in base if rng.random() > 0.08] + rng.sample(range(10_000, 20_000), rng.randint(0, size // 9))
        both = len(set(base) & set(other))
        if not other or 100 * both < 85 * len(set(base) | set(other)):
            continue
        one, two = (set(sorted(s)[: jj.prefix_length(len(s))]) for s in (base, other))
        for s in (base, other):
            smallest = -(-85 * len(s) // 100)
            assert len(one & two) >= jj._shared(smallest)


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(10**6, 90, replace=False)).astype(np.uint64)
    sets = [base[:1], base[:2]]
    for i in range(40):
        kept = base[rng.random(90) > rng.choice([0.01, 0.05, 0.1])]
        sets.append(np.unique(np.r_[kept, rng.choice(10**6, rng.integers(0, 6)).astype(np.uint64)]))
    label = list(range(len(sets)))
    for a, b in jj.tree_links(sets, list(range(len(sets)))):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 185 * both >= 85 * (len(sets[a]) + len(sets[b]))
        label = [label[b] if x == label[a] else x for x in label]
    by_hand = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 185 * both >= 85 * (len(sets[i]) + len(sets[j])):
            by_hand = [by_hand[j] if x == by_hand[i] else x for x in by_hand]
    same = lambda ls: {frozenset(i for i, x in enumerate(ls) if x == v) for v in ls}
    assert same(label) == same(by_hand)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    edges = spark.createDataFrame([*chain, (None, 5)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(edges.filter(F.lit(False))).count() == 0


def windows_by_hand(docs, size=13):
    first = {}
    order = lambda i: (i is None, i or 0)
    split = [(i, words(t)) for i, t in docs]
    for doc_id, own in split:
        for k in range(len(own) - size + 1):
            window = tuple(own[k : k + size])
            first[window] = min(first.get(window, (True, 0)) if window in first else order(doc_id), order(doc_id))
    out = []
    for doc_id, own in split:
        gone = set()
        for k in range(len(own) - size + 1):
            if first[tuple(own[k : k + size])] < order(doc_id):
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        out.append((doc_id, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [1 << 22, 2_000])
def test_substring_dedup(spark, shard_bytes):
    rows = [*edge_rows(), *related_rows(12)]
    passage = prose(70, 55)
    rows += [(400 - i, " ".join([*prose(71 + i, i), *passage, *prose(90 + i, 9)]), "en", "a") for i in range(15)]
    docs = edge_docs(spark, rows).repartition(5)
    kept = drop_repeated_windows(docs, shard_bytes)
    found = sorted(
        (tuple(r) for r in kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()),
        key=repr,
    )
    by_hand = windows_by_hand(documents(docs))
    assert found == by_hand
    assert sum(r[2] for r in by_hand) > 1_000


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(3)
    text = np.r_[rng.integers(1, 7, 400), 0].astype(np.int64)
    index = FmIndex(text, 7, 4)
    patterns = np.array([[a, b, c] for a in range(1, 7) for b in range(1, 7) for c in range(1, 7)])
    matched, low, high = index.search(patterns)
    for pattern, length, a, b in zip(patterns, matched, low, high):
        starts = [i for i in range(len(text) - 2) if (text[i : i + 3] == pattern).all()]
        if len(starts) > 1:
            assert length == 3 and sorted(index.suffixes[a:b]) == starts


def test_empty_tables(spark):
    none = edge_docs(spark).filter(F.lit(False))
    assert jj.near_duplicate_report(none).count() == 0
    assert jj.one_per_group(none).count() == 0
    assert substring_report(none).count() == 0


def test_components_of_chains_stars_and_loops_in_few_rounds(spark, monkeypatch):
    """A round leaves half of the nodes at most, so later rounds are small."""
    written = []
    monkeypatch.setattr(contraction, "stored", lambda df, label="table": written.append(label) or stored(df, label))
    chain = [(k, k + 1) for k in range(1, 500)]
    mixed = [(1000 + (k * 7919) % 500, 1000 + ((k + 1) * 7919) % 500) for k in range(499)]
    star = [(3000 - k, 3000) for k in range(1, 300)]
    odd = [(5000, 5000), (None, 6000), (6001, None)]
    edges = spark.createDataFrame(chain + mixed + star + odd + chain, "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    expected = {k: 1 for k in range(1, 501)} | {k: 1000 for k in range(1000, 1500)}
    expected |= {k: 2701 for k in range(2701, 3001)} | {5000: 5000}
    assert found == expected
    assert written.count("picks") <= 9
    assert components(edges.limit(0)).count() == 0
