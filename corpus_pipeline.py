"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the
columns of ``documents``. A stage's result is written before the next one reads it, so the next
one first deletes what the stage before left among the intermediates.

Null, empty and very long texts, null ids, ties, repeated rows and empty tables go through every
stage as the operator called there says; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.llm.common import SPACE, table, whole_text
from lodgecast.llm.jaccard_join import one_per_group
from lodgecast.llm.line_dedup import drop_shared_lines
from lodgecast.llm.mixing import mixed_rows
from lodgecast.llm.packing import pack_documents
from lodgecast.llm.quality_rules import keep_good
from lodgecast.plans.storage import stored
from lodgecast.session import delete_scratch, scratch_noted

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}  # by stage: intermediates that its result may still be read from


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that deletes the intermediates of the one named ``before``, unless its own input
    still reads them."""

    def wrap(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            paths = _left.get(before, []) if before else []
            read = docs.inputFiles() if paths else []
            names = {path.rsplit("/", 1)[-1] for path in paths}  # unique, however a path is spelt
            if not any(names.intersection(file.split("/")) for file in read):
                delete_scratch(spark, paths)
                _left.pop(before, None)
            with scratch_noted() as written:
                result = stage(spark, docs, sf_dir)
            _left[stage.__name__] = written
            return result

        return run_stage

    return wrap


@_after(None)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and their group's fences."""
    return keep_good(docs)


@_after("quality_stage")
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; those left without a word go.

    ``n_chars`` becomes the length of what is left, where the documents have that column.
    """
    cleaned = drop_shared_lines(docs)
    emptied = (F.col("_llm_dropped") > 0) & (F.btrim(whole_text(), F.lit(SPACE)) == "")
    kept = cleaned.filter(~emptied)
    if "n_chars" in docs.columns:
        left = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("_llm_dropped") > 0, left).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


@_after("line_stage")
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_per_group(docs)


@_after("near_duplicate_stage")
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixed_rows(docs)


@_after("mixing_stage")
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents' pieces with their sequence and place in it."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None  # The mix is drawn, and the packing found by search: neither is SQL.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``. Written results of stages go once the next is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        with scratch_noted() as own:
            docs = stored(result, f"pipeline-{name}")
        delete_scratch(spark, written)
        written = own
    return STAGES[-1][1](spark, docs, sf_dir)
