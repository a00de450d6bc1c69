"""The named queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.llm.common import table
from lodgecast.llm.html_extract import extract_main_text
from lodgecast.llm.jaccard_join import near_duplicate_report
from lodgecast.llm.lexical_rank import rank_report
from lodgecast.llm.license_scan import scan_licenses
from lodgecast.llm.line_dedup import line_report
from lodgecast.llm.mixing import mix_report
from lodgecast.llm.packing import pack_documents
from lodgecast.llm.periodic_runs import run_report
from lodgecast.llm.quality_classifier import classify
from lodgecast.llm.quality_rules import rules_report
from lodgecast.llm.repeat_dedup import repeat_report
from lodgecast.llm.substring_dedup import substring_report
from lodgecast.llm.topk_search import exact_top_k


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_report(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_bag_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_report(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cube_mix,
        op2_html_extraction,
        op3_jaccard_join,
        op4_exact_top_k,
        op5_quality_classifier,
        op6_line_dedup,
        op7_quality_rules,
        op8_best_fit_packing,
        op9_substring_dedup,
        op10_license_scan,
        op11_bag_lexical_search,
        op12_suffix_array_dedup,
        op13_periodic_runs,
    )
}
