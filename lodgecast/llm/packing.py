"""Best-fit packing of tokenized documents into sequences under several capacities.

Texts are tokenized inside Spark tasks; from then on a piece is a row of a few numbers. Pieces
are dealt to shards of bounded size by hash, each shard packs its own with vector best-fit, and
the pieces of sequences that are not nearly full meet those of other shards in the next round.
Only these numbers are shuffled, never texts or ids, and no task sees more than a shard.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.plans.storage import stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD_ROWS = 16_384  # pieces one task packs together
ROUNDS = 3
NEARLY_FULL = 0.99
_JOINED = 2_000  # words encoded as one text
_TEXTS = 8  # of such texts at a time: a token being encoded takes a hundred times its id
CACHED_WORDS = 300_000  # a generation, two per worker, some 60 MB each; others are encoded again
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_IS_MARK = np.isin(np.arange(256), list(_MARKS.encode()))
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_IS_SMALL = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
_IS_LATIN = np.isin(np.arange(256), sorted({*range(0x80, 0xC0)} - {0x97, 0xB7}))  # after 0xC3
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+|[%s]+" % re.escape(_MARKS).encode())
# What vocabularies like the given one do to a text before they look at its bytes.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> np.ndarray:
        """A piece has at least one token, so an unset capacity gets a bound that cannot bind."""
        return np.array(
            [self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float
        )


@dataclass
class _Plain:
    """For a tokenizer that takes letters in small ones and apart from other characters: ``tokenizer``
    gives plain words (``_PLAIN``) the same ids without normalizing and matching them, the last of
    each word being one of ``last``; ``added`` are tokens that texts may hold as they are."""

    tokenizer: object
    last: np.ndarray
    added: list[bytes]


@dataclass
class _Encoder:
    """A tokenizer and the words it has encoded; ``mark`` is a character whose word is one id.

    Words stay for as long as they are used: once ``known`` is full it becomes ``older``, from
    which words still met move to the new ``known``. So words met once cannot drive out others.
    """

    tokenizer: object
    known: dict[bytes, bytes]
    mark: str
    mark_id: int
    older: dict[bytes, bytes] = field(default_factory=dict)
    plain: _Plain | None = None


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core only
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    for mark in "|~^@#":
        ids = tokenizer.encode(f"{mark} {mark}", add_special_tokens=False).ids
        if len(ids) == 2 and ids[0] == ids[1] and mark in tokenizer.id_to_token(ids[0]):
            return _Encoder(tokenizer, {}, mark, ids[0], plain=_plain(tokenizer))
    return _Encoder(tokenizer, {}, "", -1, plain=_plain(tokenizer))


def _plain(tokenizer) -> _Plain | None:
    """None if the tokenizer is not of that kind, or does not end words in tokens of their own."""
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer.to_str())
    steps, model = (spec["pre_tokenizer"] or {}).get("pretokenizers"), spec["model"]
    if not steps or spec["normalizer"] != _NORMALIZER or steps[0] != _SPLIT or len(steps) != 2:
        return None
    if steps[1]["type"] != "ByteLevel" or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    end = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not end or model["dropout"] or model["unk_token"] or model["byte_fallback"]:
        return None
    last = np.zeros(1 + max(model["vocab"].values()), bool)
    last[[number for token, number in model["vocab"].items() if token.endswith(end)]] = True
    spec["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
    spec.update(normalizer=None, added_tokens=[], post_processor=None)
    added = [t["content"].lower().encode() for t in json.loads(tokenizer.to_str())["added_tokens"]]
    return _Plain(Tokenizer.from_str(json.dumps(spec)), last, added)


def _parted(texts: list[bytes], added: list[bytes]) -> list[bytes]:
    """The texts in small ASCII letters, with a space before punctuation that ends a word after a
    letter, so that far fewer different words are left.

    Texts with added tokens, or with accents of their own (U+0300 to U+037F), which compose with
    some letters in one case only, stay as they are.
    """
    small = [t.lower() for t in texts]
    safe = [
        k
        for k, t in enumerate(small)
        if b"\xcc" not in t and b"\xcd" not in t and not any(a in t for a in added)
    ]
    out = list(texts)
    joined = b"".join([small[k] + b"\n" for k in safe])
    raw = np.frombuffer(b"\n\n" + joined, np.uint8)
    marks = np.flatnonzero(_IS_MARK[raw])
    if len(marks):
        gaps = np.flatnonzero(np.diff(marks) > 1)
        first, after = marks[np.r_[0, gaps + 1]], marks[np.r_[gaps, -1]] + 1
        letter = _IS_SMALL[raw[first - 1]] | (_IS_LATIN[raw[first - 1]] & (raw[first - 2] == 0xC3))
        cuts = first[letter & _IS_SPACE[raw[after]]]
        joined = np.insert(raw, cuts, 0x20).tobytes()[2:]
        cuts -= 2
    else:
        cuts = marks
    ends = np.cumsum([len(small[k]) + 1 for k in safe], dtype=np.int64)
    ends += np.searchsorted(cuts, ends)
    for k, a, b in zip(safe, [0, *ends.tolist()], ends.tolist()):
        out[k] = joined[a:b]
    return out


def _encode_new(encoder: _Encoder, words: list[bytes]) -> dict[bytes, bytes]:
    """Ids of each word, plain ones without normalizing and matching them."""
    if encoder.plain is None:
        return dict(zip(words, _encode_words(encoder, words)))
    plain = [w for w in words if _PLAIN.fullmatch(w)]
    rest = [w for w in words if not _PLAIN.fullmatch(w)]
    new = dict(zip(rest, _encode_words(encoder, rest)))
    groups = [plain[at : at + _JOINED] for at in range(0, len(plain), _JOINED)]
    joined = [b" ".join(g).decode() for g in groups]
    for group, coded in zip(groups, _ids(encoder.plain.tokenizer, joined)):
        ids = np.array(coded, np.uint32)
        ends = (4 * np.flatnonzero(encoder.plain.last[ids]) + 4).tolist()
        if len(ends) != len(group):  # the vocabulary lacks some last character
            new.update(zip(group, _encode_words(encoder, group)))
            continue
        raw = ids.tobytes()
        new.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
    return new


def _encode_words(encoder: _Encoder, words: list[bytes]) -> list[bytes]:
    """Ids of each word. Words are encoded many in one text, with a mark between them; those that
    hold the mark themselves, and all if there is no mark, are encoded each on its own."""
    texts = [w.decode("utf-8", "replace") for w in words]
    mark, out = encoder.mark, [b""] * len(words)
    alone = [k for k, t in enumerate(texts) if not mark or mark in t]
    rest = [k for k, t in enumerate(texts) if mark and mark not in t]
    groups = [rest[at : at + _JOINED] for at in range(0, len(rest), _JOINED)]
    joined = [f" {mark} ".join([texts[k] for k in g]) for g in groups]
    for group, coded in zip(groups, _ids(encoder.tokenizer, joined)):
        ids = np.array(coded, np.uint32)
        cuts = 4 * np.flatnonzero(ids == encoder.mark_id)
        if len(cuts) + 1 != len(group):  # the mark came out of some word after all
            alone += group
            continue
        raw = ids.tobytes()
        for k, a, b in zip(group, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]):
            out[k] = raw[a:b]
    for k, coded in zip(alone, _ids(encoder.tokenizer, [texts[k] for k in alone], _TEXTS * _JOINED)):
        out[k] = array("I", coded).tobytes()
    return out


def _ids(tokenizer, texts: list[str], together: int = _TEXTS) -> Iterator[list[int]]:
    """Ids of each text, ``together`` of them encoded at a time."""
    for at in range(0, len(texts), together):
        for c in tokenizer.encode_batch_fast(texts[at : at + together], add_special_tokens=False):
            yield c.ids


def _encode(texts: list[bytes | None], path: str | None) -> Iterator[bytes]:
    """Ids of each text as 32-bit numbers (little-endian on every machine Spark runs on), the end
    id last.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order, and each distinct word needs to be encoded once.
    """
    encoder = _encoder(path)
    texts = [text or b"" for text in texts]
    split = [text.split() for text in (_parted(texts, encoder.plain.added) if encoder.plain else texts)]
    found = [list(map(encoder.known.get, ws)) for ws in split]
    lacking = [k for k, parts in enumerate(found) if None in parts]
    new: dict[bytes, bytes] = {}
    if lacking:
        words = {w for k in lacking for w, p in zip(split[k], found[k]) if p is None}
        new = {w: encoder.older[w] for w in words if w in encoder.older}
        unseen = [w for w in words if w not in new]
        new.update(_encode_new(encoder, unseen))
        if len(encoder.known) + len(new) > CACHED_WORDS:
            encoder.known, encoder.older = {}, encoder.known  # these texts have what they need
        encoder.known.update(new)
    end = array("I", [END_ID]).tobytes()
    for ws, parts in zip(split, found):
        if None in parts:
            parts = [new[w] if p is None else p for w, p in zip(ws, parts)]
        yield b"".join(parts) + end


def token_pieces(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids, cut every ``capacity``.

    Null and empty texts have the end id only. ``path`` names a tokenizer file on the executors.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_pylist()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                rows = []
                for doc_id, coded in zip(ids, _encode(texts, path)):
                    for k, first in enumerate(range(0, len(coded), 4 * capacity)):
                        chunk = coded[first : first + 4 * capacity]
                        rows.append((doc_id, k, first // 4, len(chunk) // 4, zlib.crc32(chunk)))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int32()),
                        *[pa.array(c, pa.int64()) for c in columns[2:]],
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECES)


def best_fit(lengths: np.ndarray, capacity: Capacity, weights: tuple[float, ...], by: str) -> np.ndarray:
    """Bin of each piece; longest first, each into the fitting bin that scores best.

    Demands and residuals are vectors (tokens, documents, attention) in shares of the capacity.
    ``by="norm"`` takes the bin whose weighted residual is shortest after placing, ``by="dot"``
    the one whose residual has the smallest weighted dot product with the demand. A bin is
    only a candidate if the piece fits in every dimension.
    """
    limits, scale = capacity.limits(), np.array(weights, float)
    demands = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], 1) / limits
    order = np.argsort(-lengths, kind="stable")
    bins = np.full(len(lengths), -1, np.int64)
    residual = np.empty((max(16, len(lengths)), 3))
    numbers = np.empty(len(residual), np.int64)
    used = made = 0
    smallest = demands.min(0) if len(lengths) else None
    for step, item in enumerate(order):
        need = demands[item]
        if step % 256 == 255:  # full bins can take nothing more
            alive = (residual[:used] >= smallest - 1e-12).all(1)
            count = int(alive.sum())
            residual[:count], numbers[:count] = residual[:used][alive], numbers[:used][alive]
            used = count
        left = residual[:used] - need
        fits = np.flatnonzero((left >= -1e-12).all(1))
        if len(fits):
            rest = left[fits]
            score = (rest * rest) @ scale if by == "norm" else (residual[fits] * need) @ scale
            place = int(fits[int(np.argmin(score))])
        else:
            place, used, made = used, used + 1, made + 1
            residual[place], numbers[place] = 1.0, made - 1
        residual[place] -= need
        bins[item] = numbers[place]
    return bins


def _shard_packer(turn: int, capacity: Capacity, weights: tuple[float, ...], by: str):
    limits = capacity.limits()

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("_llm_row").reset_index(drop=True)
        bins = best_fit(shard["length"].to_numpy(np.int64), capacity, weights, by)
        shard["sequence_id"] = (turn << 58) + (int(shard["_llm_shard"].iloc[0]) << 30) + bins
        by_bin = shard.groupby("sequence_id", sort=False)["length"]
        shard["offset"] = by_bin.cumsum() - shard["length"]
        cost = (shard["length"] ** 2).groupby(shard["sequence_id"]).transform("sum")
        totals = (by_bin.transform("sum"), by_bin.transform("size"), cost)
        fill = np.max([total / limit for total, limit in zip(totals, limits)], axis=0)
        shard["_llm_open"] = fill < NEARLY_FULL
        return shard

    return pack_shard


def pack(
    pieces: DataFrame,
    capacity: Capacity = Capacity(),
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    by: str = "norm",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    A piece that fills a sequence alone gets one to itself. The others are packed in shards;
    ``ROUNDS`` times, the pieces of sequences less than ``NEARLY_FULL`` are pooled and packed
    again with those of other shards. No sequence is over any capacity; a single piece over the
    document or attention capacity gets a sequence of its own. Null ids, repeated rows and ties
    are pieces like any other; an empty table gives an empty table.
    """
    columns = pieces.columns
    schema = f"{_ddl(pieces)}, _llm_row long, _llm_shard long, sequence_id long, offset long, _llm_open boolean"
    rows = stored(pieces.withColumn("_llm_row", F.monotonically_increasing_id()), "pack-pieces")
    full = F.col("length") >= capacity.tokens
    top = 7 << 58
    done = [
        rows.filter(full).select(
            *columns, (F.col("_llm_row") + F.lit(top)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    ]
    left = rows.filter(~full)
    for turn in range(ROUNDS):
        shards = -(-left.count() // shard_rows)
        last = shards <= 1 or turn == ROUNDS - 1

        dealt = left.withColumn(
            "_llm_shard", F.pmod(F.xxhash64("_llm_row", F.lit(turn)), F.lit(max(1, shards)))
        )
        packed = dealt.groupBy("_llm_shard").applyInPandas(
            _shard_packer(turn, capacity, weights, by), schema
        )
        packed = stored(packed, "packed")
        closed = packed if last else packed.filter(~F.col("_llm_open"))
        done.append(closed.select(*columns, "sequence_id", "offset"))
        if last:
            break
        left = packed.filter("_llm_open").select(*columns, "_llm_row")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every document's pieces, packed: the report of the whole operator."""
    return pack(token_pieces(docs, path=path))
