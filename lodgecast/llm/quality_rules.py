"""Quality rules whose thresholds adapt to each language and source.

Every document is measured once with array functions. The measures are ratios in whole steps of
one ten-thousandth, so a histogram with at most ``STEPS + 1`` counts is a quantile sketch that is
exact to one step, does not depend on the order of rows, and merges by adding counts. Sketches
per (language, source) come from one map-side combined aggregation; those of the languages are
sums of them. Fences are read off the sketches and joined back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.llm.common import SPACE, null_safe_key, split_words, whole_text
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.storage import stored

STEPS = 10_000
MIN_WORDS = 50
MIN_GROUP = 200  # documents a (language, source) needs for fences of its own


@dataclass(frozen=True)
class Fence:
    """An upper fence at median + ``spread`` * max(upper quartile - median, ``least`` steps).

    ``spread`` and ``least`` say how far from the bulk of its group a document may lie; the
    place of the bulk and its width come from the sketch.
    """

    measure: str
    spread: int
    least: int


FENCES = (Fence("symbols", 6, 60), Fence("dup_lines", 6, 800), Fence("repeats", 6, 800))


def measure_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_llm_rules``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed and the measures ``symbols``, ``dup_lines``, ``repeats``.

    Three-word windows are compared by a 64-bit hash within one document. Null text has no
    words. Texts of any length are measured whole; the work is n log n in their words.
    """
    text = whole_text()
    words = docs.withColumn("_llm_text", text).withColumn("_llm_words", split_words(text))
    solid = F.filter(F.split("_llm_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    w = F.col("_llm_words")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        *docs.columns,
        F.size(w).cast("long").alias("_llm_n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("_llm_word_chars"),
        (
            F.length("_llm_text") - F.length(F.regexp_replace("_llm_text", r"[#*$%&|<>]+", ""))
        ).cast("long").alias("_llm_n_symbols"),
        solid.alias("_llm_solid"),
        windows.alias("_llm_windows"),
    )
    g = F.col("_llm_windows")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = F.when(
        repeats,
        F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(none)
    sorted_windows = counted.select(
        "*",
        F.size("_llm_solid").cast("long").alias("_llm_n_solid"),
        (F.size("_llm_solid") - F.size(F.array_distinct("_llm_solid"))).cast("long").alias("_llm_n_dup"),
        ordered.alias("_llm_ordered"),
    ).drop("_llm_solid", "_llm_windows")
    s = F.col("_llm_ordered")
    starts = F.transform(
        s,
        lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
        ),
    )
    covered = F.aggregate(
        F.sort_array(F.array_compact(starts)),
        F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
        lambda a, x: F.struct(
            (a["words"] + F.least(F.lit(3), x - a["last"])).alias("words"), x.alias("last")
        ),
        lambda a: a["words"].cast("long"),
    )
    measured = sorted_windows.withColumn("_llm_n_repeat", covered).drop("_llm_ordered")
    n, chars = F.col("_llm_n_words"), F.col("_llm_word_chars")
    rules = F.struct(
        n.alias("n_words"),
        chars.alias("word_chars"),
        F.col("_llm_n_symbols").alias("n_symbols"),
        F.col("_llm_n_dup").alias("n_dup_lines"),
        F.col("_llm_n_repeat").alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * F.col("_llm_n_repeat") > 50 * n)).alias("base_failed"),
        _share(F.col("_llm_n_symbols"), chars).alias("symbols"),
        _share(F.col("_llm_n_dup"), F.col("_llm_n_solid")).alias("dup_lines"),
        _share(F.col("_llm_n_repeat"), n).alias("repeats"),
    )
    return measured.select(*docs.columns, rules.alias("_llm_rules"))


def _share(part: Column, whole: Column) -> Column:
    """part / whole in whole steps, 0 where there is nothing to divide by."""
    steps = F.least(F.lit(STEPS).cast("long"), F.floor(STEPS * part / whole))
    return F.when(whole > 0, steps).otherwise(F.lit(0).cast("long"))


def quantile_sketches(measured: DataFrame) -> DataFrame:
    """Counts per (language, source, measure, step) of the documents that pass the base rules."""
    cells = F.array(
        *[F.struct(F.lit(f.measure).alias("measure"), F.col(f"_llm_rules.{f.measure}").alias("step")) for f in FENCES]
    )
    return (
        measured.filter(~F.col("_llm_rules.base_failed"))
        .select("lang", "source", F.explode(cells).alias("_cell"))
        .groupBy("lang", "source", "_cell.measure", "_cell.step")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Upper fence and size of each group and measure, read off its sketch."""
    merged = sketches.groupBy(*by, "measure", "step").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*by, "measure")
    upto = F.sum("rows").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    places = merged.withColumns({"_upto": upto, "_all": F.sum("rows").over(group)})
    at = lambda share: F.min(F.when(100 * F.col("_upto") >= share * F.col("_all"), F.col("step")))
    read = places.groupBy(*by, "measure").agg(
        at(50).alias("_mid"), at(75).alias("_high"), F.max("_all").alias("group_rows")
    )
    spread = F.create_map(*[x for f in FENCES for x in (F.lit(f.measure), F.lit(f.spread))])
    least = F.create_map(*[x for f in FENCES for x in (F.lit(f.measure), F.lit(f.least))])
    return read.select(
        *by,
        "measure",
        "group_rows",
        (
            F.col("_mid")
            + spread[F.col("measure")]
            * F.greatest(F.col("_high") - F.col("_mid"), least[F.col("measure")].cast("long"))
        ).alias("fence"),
    )


def adaptive_thresholds(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (language, source): ``_llm_group`` and a fence for each measure.

    A group's fence may not lie above that of its language, so a source full of junk cannot
    vouch for itself; groups of fewer than ``min_group`` documents use their language's fence.
    """
    sketches = stored(quantile_sketches(measured), "quantile-sketches")
    own = _fences(sketches, ["lang", "source"])
    wider = _fences(sketches, ["lang"]).select(
        F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.col("fence").alias("_wide")
    )
    both = own.join(
        wider,
        F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")),
    )
    fence = F.when(F.col("group_rows") < min_group, F.col("_wide")).otherwise(
        F.least("fence", "_wide")
    )
    return (
        both.withColumn("_fence", fence)
        .groupBy("lang", "source")
        .agg(*[F.max(F.when(F.col("measure") == f.measure, F.col("_fence"))).alias(f"_llm_max_{f.measure}") for f in FENCES])
        .select(
            null_safe_key(F.col("lang"), F.col("source")).alias("_llm_group"),
            *[f"_llm_max_{f.measure}" for f in FENCES],
        )
    )


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` (a scan or stored frame) with ``_llm_kept``.

    False where the base rules fail, or a measure lies above its group's fence. Language and
    source may be null; null is a group like any other. Ties at a fence stay. An empty table
    gives an empty table.
    """
    fences = adaptive_thresholds(measured)
    keyed = measured.withColumn("_llm_group", null_safe_key(F.col("lang"), F.col("source")))
    joined = lookup_join(keyed, fences, ["_llm_group"], "left")
    inside = ~F.col("_llm_rules.base_failed")
    for f in FENCES:
        limit = F.col(f"_llm_max_{f.measure}")
        inside = inside & F.coalesce(F.col(f"_llm_rules.{f.measure}") <= limit, F.lit(True))
    return joined.withColumn("_llm_kept", inside).drop(
        "_llm_group", *[f"_llm_max_{f.measure}" for f in FENCES]
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the same columns."""
    return judge(stored(measure_rules(docs), "rules")).filter("_llm_kept").select(*docs.columns)


def rules_report(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document."""
    narrow = docs.select("doc_id", "lang", "source", "text")
    measured = stored(measure_rules(narrow).drop("text"), "rules")
    return judge(measured).select(
        "doc_id",
        *[f"_llm_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        F.col("_llm_kept").alias("kept"),
    )
