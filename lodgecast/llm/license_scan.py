"""Licence scans: texts whose canonical form is that of a known licence.

Case, punctuation, copyright lines and equivalent spellings are normalised, and the digest of the
entire canonical text is joined to the digests of known licences. Entire texts are whole
documents (licence files) and whole lines (licence notices inside other documents).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.llm.common import whole_text
from lodgecast.llm.license_texts import KNOWN
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.storage import small_frame, stored

# Spellings that count as the same, each with the one used.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("centre", "center"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
SPACED = tuple((one, used) for one, used in SPELLINGS if " " in one)  # may lie across a line break
# "COPYRIGHT HOLDERS BE LIABLE" at the start of a line belongs to the licence.
COPYRIGHT_LINE = r"^(portions )?copyright( c)?( [0-9]{4}|$| by | holders?( c)? [0-9]{4}| holders? c )|^c [0-9]{4}|^all rights reserved$"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that is neither blank nor a copyright line."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    for one, used in SPELLINGS:
        plain = F.replace(plain, F.lit(one), F.lit(used))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.btrim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def canonical_text(lines: Column) -> Column:
    """Canonical form of a whole text from that of its lines, wherever they were broken."""
    joined = F.array_join(lines, " ")
    for one, used in SPACED:
        joined = F.replace(joined, F.lit(one), F.lit(used))
    return joined


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """``_llm_digest, _llm_license`` of known licence texts; the smallest name wins a tie.

    The texts travel as one literal: a column for each would make the plan slow to build.
    """
    rows = json.dumps([{"license": name, "text": text} for name, text in known])
    kind = "array<struct<license:string,text:string>>"
    texts = small_frame(spark, [(rows,)], "rows string").select(F.inline(F.from_json("rows", kind)))
    joined = canonical_text(canonical_lines(F.col("text")))
    return (
        texts.select("license", joined.alias("_llm_text"))
        .groupBy(F.sha2("_llm_text", 256).alias("_llm_digest"))
        .agg(F.min("license").alias("_llm_license"))
    )


def scan_licenses(docs: DataFrame, known: Sequence[tuple[str, str]] = KNOWN) -> DataFrame:
    """Per row of ``docs``: doc_id, canonical_sha256, license_id, notice_ids, n_notice_lines.

    ``license_id`` is the licence whose entire canonical text the document is (null if none).
    ``notice_ids`` are the licences that a whole line of the document names, sorted, and
    ``n_notice_lines`` is the number of such lines. Null, empty and copyright-only texts have
    the empty canonical form, which is no licence. Rows without ``doc_id`` and repeated rows are
    answered like any other. An empty table gives an empty table. The known texts are few: their
    digests are counted before they are broadcast.
    """
    digests = stored(known_digests(docs.sparkSession, known), "known-licenses")
    text = whole_text()
    lined = docs.select(
        "doc_id", F.xxhash64(text).alias("_llm_copy"), canonical_lines(text).alias("_llm_lines")
    )
    whole = lined.select(
        "doc_id", "_llm_copy", F.sha2(canonical_text(F.col("_llm_lines")), 256).alias("_llm_digest")
    )
    lines = lined.select("doc_id", "_llm_copy", F.posexplode("_llm_lines").alias("_llm_at", "_llm_line"))
    notices = (
        lookup_join(
            lines.withColumn("_llm_digest", F.sha2("_llm_line", 256)).drop("_llm_line"),
            digests,
            ["_llm_digest"],
        )
        .groupBy(F.col("doc_id").alias("_llm_doc"), F.col("_llm_copy").alias("_llm_same"))
        .agg(
            F.array_sort(F.collect_set("_llm_license")).alias("_llm_ids"),
            F.size(F.collect_set("_llm_at")).alias("_llm_found"),
        )
    )
    same_row = F.col("doc_id").eqNullSafe(F.col("_llm_doc")) & (F.col("_llm_copy") == F.col("_llm_same"))
    return (
        lookup_join(whole, digests, ["_llm_digest"], "left")
        .join(notices, same_row, "left")
        .select(
            "doc_id",
            F.col("_llm_digest").alias("canonical_sha256"),
            F.col("_llm_license").alias("license_id"),
            F.coalesce("_llm_ids", F.array().cast("array<string>")).alias("notice_ids"),
            F.coalesce("_llm_found", F.lit(0)).cast("long").alias("n_notice_lines"),
        )
    )
