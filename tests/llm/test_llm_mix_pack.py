"""Source mix, packing and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from llm_frames import documents, edge_docs, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodgecast.llm import mixing, packing
from lodgecast.llm.packing import (
    NEARLY_FULL,
    ROUNDS,
    VOCABULARY,
    Capacity,
    best_fit,
    pack,
    pack_documents,
    token_pieces,
)


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """sizes by source; shares are handed out again until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def test_mix_of_awkward_rows(spark):
    docs = edge_docs(spark)
    found = mixing.mix_report(docs).collect()
    assert len(found) == docs.count()
    assert all(r.taken <= 3 * r.size for r in found)
    sources = {(r.doc_id, r.text): r.source for r in docs.select("doc_id", "text", "source").collect()}
    sizes = defaultdict(int)
    for (_, text), source in sources.items():
        sizes[source] += len((text or "").split())
    sizes["a"] += 120  # the repeated row
    by_hand = targets_by_hand(sizes)
    assert {r.source_size for r in found} == set(sizes.values())
    for r in found:
        source = next(s for s, n in sizes.items() if n == r.source_size)
        assert r.target == pytest.approx(by_hand[source])


def test_mix_meets_its_targets_and_repeats_itself(spark):
    rng = random.Random(3)
    rows = [(i, "w " * min(2_000, int(rng.paretovariate(1.1) * 20)), "en", rng.choice("aaaaaabbc")) for i in range(3_000)]
    docs = edge_docs(spark, rows)
    mixed = mixing.mix_sources(docs, cell_rows=256)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    first = {r.doc_id: r for r in mixed.collect()}
    for source in "abc":
        own = [r for r in first.values() if r.source == source]
        taken = sum(r._llm_size * r._llm_times for r in own)
        assert abs(taken - own[0]._llm_target) < 0.01 * own[0]._llm_target
        ratio = own[0]._llm_target / own[0]._llm_source_size
        assert {r._llm_times for r in own} <= {int(ratio), int(ratio) + 1}
        assert abs(sum(r._llm_times for r in own) - ratio * len(own)) < 12  # the document total
    again = mixing.mix_sources(docs.repartition(7), cell_rows=256).collect()
    assert {r.doc_id: r._llm_times for r in again} == {i: r._llm_times for i, r in first.items()}


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [rng.randint(0, 500) for _ in range(300)]
    chances = [rng.random() for _ in sizes]
    moved = mixing.flight(sizes, chances, [rng.random() for _ in sizes])
    assert sum(0 < c < 1 for c in moved) <= mixing.TOTALS
    assert sum(moved) == pytest.approx(sum(chances))
    assert np.dot(moved, sizes) == pytest.approx(np.dot(chances, sizes))


def test_flight_keeps_every_chance_on_average():
    rng = random.Random(2)
    sizes, chances = [5, 9, 2, 7, 7], [0.2, 0.5, 0.7, 0.4, 0.6]
    runs = [mixing.flight(sizes, chances, [rng.random() for _ in sizes]) for _ in range(8_000)]
    assert np.allclose(np.mean(runs, axis=0), chances, atol=0.02)


def test_mixed_rows_repeat_whole_documents(spark):
    docs = edge_docs(spark)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() <= 3 * docs.count()
    assert mixing.mixed_rows(docs.filter(F.lit(False))).count() == 0


def test_tokens_are_those_of_whole_texts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    awkward = ["it's á café nbsp em <|endoftext|>x ΑΣ Σ. İI", "\x1c\x1dx\x85y", "don't''s 123 ab12"]
    awkward += ["| a|b || ~ ~x ^ \u0301e e\u0301 | \u0301", "\u0378 |\u0301 x|\u0338 \ufffd", "|", " | | "]
    rows = [(900 + i, t, "en", "a") for i, t in enumerate(awkward)]
    docs = edge_docs(spark).unionByName(edge_docs(spark, rows))
    pieces = defaultdict(list)
    for r in sorted(token_pieces(docs, capacity=64).collect(), key=lambda r: r.piece):
        pieces[r.doc_id].append(r)
    for doc_id, text in documents(docs):
        if doc_id in (5, None):  # ids that several texts share
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = pieces[doc_id]
        assert [p.start for p in own] == list(range(0, len(ids), 64)), (doc_id, text)
        for p in own:
            part = np.array(ids[p.start : p.start + 64], "<u4")
            assert (p.length, p.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))


def test_words_are_encoded_alike_together_and_alone(monkeypatch):
    """With the mark, without one, and with a cache that is emptied again and again."""
    texts = [" ".join([*prose(k, 300), "|", "a|b", "é", f"{k}"]).encode() for k in range(9)]
    whole = list(packing._encode(texts, None))
    encoder = packing._encoder(None)
    assert encoder.mark and len(encoder.known) > 1000
    for mark, most in ((encoder.mark, 50), ("", 50), ("z", 10**6)):  # "z" comes out of words
        monkeypatch.setattr(packing, "CACHED_WORDS", most)
        other = packing._Encoder(encoder.tokenizer, {}, mark, encoder.mark_id)
        monkeypatch.setattr(packing, "_encoder", lambda path: other)
        assert [next(packing._encode([t], None)) for t in texts] == whole
        assert len(other.known) < most + 1_000


def test_words_in_use_are_encoded_once_however_many_others_come(monkeypatch):
    known = packing._encoder(None)
    encoder = packing._Encoder(known.tokenizer, {}, known.mark, known.mark_id)
    asked = []
    encode_words = packing._encode_words

    def counted(encoder, words):
        asked.extend(words)
        return encode_words(encoder, words)

    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    monkeypatch.setattr(packing, "_encoder", lambda path: encoder)
    monkeypatch.setattr(packing, "_encode_words", counted)
    for k in range(30):
        text = " ".join(["often", "used", *[f"rare{k}x{j}" for j in range(10)]]).encode()
        ids = known.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert np.frombuffer(next(packing._encode([text], None)), "<u4").tolist() == [*ids, 1]
    assert asked.count(b"often") == asked.count(b"used") == 1
    assert len(encoder.known) <= 40 and len(encoder.older) <= 40


def test_words_in_other_cases_and_before_punctuation_are_encoded_once(monkeypatch):
    asked = []
    encode_new = packing._encode_new

    def counted(encoder, words):
        asked.extend(words)
        return encode_new(encoder, words)

    known = packing._encoder(None)
    other = packing._Encoder(known.tokenizer, {}, known.mark, known.mark_id, plain=known.plain)
    monkeypatch.setattr(packing, "_encoder", lambda path: other)
    monkeypatch.setattr(packing, "_encode_new", counted)
    text = "Harbour harbour, HARBOUR. harbour!!! caf\u00e9 caf\u00e9, harbour."
    ids = known.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(packing._encode([text.encode()], None)), "<u4").tolist() == [*ids, 1]
    assert sorted(asked) == [b"!!!", b",", b".", b"caf\xc3\xa9", b"harbour"]


def test_parted_texts_have_the_ids_of_whole_ones():
    """Accents of their own, added tokens, contractions, signs between letters, bytes that are no text."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    signs = ["h", "H", "E", "s", "S", "\u00e9", "\u00c9", "\u00d7", "\u00f7", "\u00df", "\u0130", "\u03a3", "\u212a"]
    signs += ["\u0331", "\u0301", "\u0338", "'", "'s", "'LL", ".", "=", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    signs += ["7", "\u00b2", "\u00aa", "\u00ab", "\u2026", "\u4e2d", " ", " ", "\n", "\x1c", "\x85", "\u00a0", "\x00", "\ufffd"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(3_000)]
    texts += ["x", "x.", ".", "\u00e9.", "", " ", "no marks here"]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for text, coded in zip(part, packing._encode([t.encode() for t in part], None)):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(coded, "<u4").tolist() == [*ids, 1], text


def test_packing_is_whole_and_tight(spark, monkeypatch):
    docs = edge_docs(spark, [(i, " ".join(prose(i, 5 + i % 90)), "en", "a") for i in range(600)])
    pieces = token_pieces(docs)
    for shard_rows in (10_000, 100):
        packed = pack(pieces, shard_rows=shard_rows).collect()
        assert sorted((r.doc_id, r.piece) for r in packed) == [(i, 0) for i in range(600)]
        bins = defaultdict(list)
        for r in packed:
            bins[r.sequence_id].append((r.offset, r.length))
        for own in bins.values():
            ends = np.cumsum([n for _, n in sorted(own)])
            assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
        least = -(-sum(r.length for r in packed) // 4096)
        assert len(bins) <= least + (1 if shard_rows == 10_000 else 3)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 500)
    capacity = Capacity(tokens=1_000, documents=6, attention=300_000)
    bins = best_fit(lengths, capacity, (1.0, 0.5, 0.5), by)
    for b in set(bins.tolist()):
        own = lengths[bins == b]
        assert own.sum() <= 1_000 and len(own) <= 6 and (own**2).sum() <= 300_000
    assert len(set(bins.tolist())) <= 1.3 * max(lengths.sum() / 1_000, 500 / 6, (lengths**2).sum() / 300_000)


def test_rounds_of_shards_with_all_capacities(spark):
    """pack() over several shards and rounds, where tokens, documents and attention all bind."""
    rng = np.random.default_rng(2)
    lengths = [700, *rng.integers(1, 60, 250), *rng.integers(100, 200, 250), *rng.integers(400, 633, 100)]
    capacity = Capacity(tokens=1_000, documents=8, attention=400_000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = pack(pieces, capacity, weights=(1.0, 0.5, 0.5), shard_rows=24).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(lengths))
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    alone, shares = [], defaultdict(list)
    for number, own in bins.items():
        sizes = np.array([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum(sizes)[:-1]]
        share = np.array([sizes.sum() / 1_000, len(sizes) / 8, (sizes**2).sum() / 400_000])
        if 700 in sizes:  # over the attention capacity by itself
            alone = sizes.tolist()
            continue
        assert (share <= 1 + 1e-9).all()
        shares[number >> 58].append(share)
    assert alone == [700]
    assert sorted(shares) == list(range(ROUNDS))
    for turn in range(ROUNDS - 1):  # only sequences that some capacity has filled are closed early
        assert min(share.max() for share in shares[turn]) >= NEARLY_FULL
    every = np.array([share for own in shares.values() for share in own])
    assert ((every >= NEARLY_FULL).sum(0) >= 3).all()
    lengths = np.array(lengths)
    least = max(lengths.sum() / 1_000, len(lengths) / 8, (lengths**2).sum() / 400_000)
    assert len(bins) <= 1.4 * least


def test_packing_awkward_rows(spark):
    docs = edge_docs(spark)
    packed = pack_documents(docs).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()
    assert pack_documents(docs.filter(F.lit(False))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert counts[-1] and (name == "packing" or docs.columns == columns)
    assert counts[0] >= counts[1] >= counts[2]
    lines = spark.read.parquet(f"{tmp_path}/line_dedup")
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if "piece" not in docs.columns:
            assert docs.count() == 0
    assert docs.count() == 0


def test_few_texts_are_encoded_at_a_time(monkeypatch):
    """A token being encoded takes far more room than its id; a worker holds a bounded number."""
    sizes = []

    class Recording:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **kwargs):
            sizes.append(sum(len(t.split()) for t in texts))
            return self.tokenizer.encode_batch_fast(texts, **kwargs)

    encoder = packing._encoder(None)
    words = [f"word{k}x".encode() for k in range(60_000)] + [b"a|b~c^d@e#f", b""]
    alone = [encoder.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words[-300:]]
    monkeypatch.setattr(encoder, "tokenizer", Recording(encoder.tokenizer))
    coded = packing._encode_words(encoder, words)
    assert [np.frombuffer(c, np.uint32).tolist() for c in coded[-300:]] == alone
    assert max(sizes) <= 2 * packing._TEXTS * packing._JOINED
