"""Line dedup: lines that several documents share stay in one document only.

Lines are exploded and hashed, documents are counted per hash with map-side combining, hashes
over the threshold are joined back, and each text is put together again by line position. Only
hashes and positions are shuffled for the counting; a text is moved once, for the last join. A
line that a third of all documents hold costs one row per task in the count, and in the join
back its rows are split by AQE, since no aggregate hangs on that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgecast.llm.common import SPACE, lower_ascii, whole_text, wide_hash
from lodgecast.plans.storage import stored

MIN_DOCS, MIN_CHARS = 2, 10


def drop_shared_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """All columns of ``docs``, ``text`` without its shared lines, and ``_llm_lines`` /
    ``_llm_dropped`` (lines before dropping, lines dropped).

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
    lines except those in the smallest ``doc_id`` that holds them.

    Null or empty text is one empty line and comes back as an empty text. Rows of one ``doc_id``
    are one document: they never make a key shared, and all keep it if theirs is the smallest
    id. Rows without ``doc_id`` come after every id: they lose a key that is shared among
    numbered documents or that one numbered document holds, and keep keys that only rows without
    id hold. Repeated rows stay repeated. An empty table gives an empty table.
    """
    text = whole_text()
    rows = docs.withColumn("_llm_copy", F.xxhash64(text)).withColumn(
        "_llm_parts", F.split(text, "\n")
    )
    key = lower_ascii(F.btrim(F.col("_llm_line"), F.lit(SPACE)))
    lines = (
        docs.select("doc_id", F.xxhash64(text).alias("_llm_copy"), text.alias("_llm_text"))
        .select("doc_id", "_llm_copy", F.posexplode(F.split("_llm_text", "\n")).alias("_llm_at", "_llm_line"))
        .select("doc_id", "_llm_copy", "_llm_at", key.alias("_llm_key"))
        .filter(F.length("_llm_key") >= min_chars)
        .select("doc_id", "_llm_copy", "_llm_at", *[
            h.alias(n) for h, n in zip(wide_hash(F.col("_llm_key")), ("_llm_h1", "_llm_h2"))
        ])
    )
    lines = stored(lines, "line-keys")  # counted and joined
    unnumbered = F.max(F.col("doc_id").isNull())
    if min_docs <= 2:  # more than one document: the ends of the ids differ, no count needed
        shared = (F.min("doc_id") != F.max("doc_id")) | unnumbered
    else:
        shared = F.count_distinct("doc_id") + F.when(unnumbered, 1).otherwise(0) >= min_docs
    common = (
        lines.groupBy("_llm_h1", "_llm_h2")
        .agg(F.min("doc_id").alias("_llm_first"), shared.alias("_llm_shared"))
        .filter(F.col("_llm_shared") & F.col("_llm_first").isNotNull())
        .drop("_llm_shared")
    )
    # Written, so that the join below is between two scans and AQE can split a hot key's rows.
    common = stored(common, "shared-lines")
    later = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_llm_first"))
    dropped = (
        lines.join(common, ["_llm_h1", "_llm_h2"])
        .filter(later)
        .groupBy(F.col("doc_id").alias("_llm_doc"), F.col("_llm_copy").alias("_llm_same"))
        .agg(F.collect_set("_llm_at").alias("_llm_gone"))
    )
    joined = rows.join(
        dropped,
        F.col("doc_id").eqNullSafe(F.col("_llm_doc")) & (F.col("_llm_copy") == F.col("_llm_same")),
        "left",
    )
    places = F.sequence(F.lit(0), F.size("_llm_parts") - 1)
    kept = F.array_except(places, F.coalesce("_llm_gone", F.array().cast("array<int>")))
    kept_text = F.array_join(F.transform(kept, lambda i: F.get(F.col("_llm_parts"), i)), "\n")
    return joined.select(
        *[kept_text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size("_llm_parts").cast("long").alias("_llm_lines"),
        F.coalesce(F.size("_llm_gone"), F.lit(0)).cast("long").alias("_llm_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    cleaned = drop_shared_lines(docs.select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("_llm_lines").alias("n_lines"),
        F.col("_llm_dropped").alias("n_dropped"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )
