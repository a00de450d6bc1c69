"""Ranking rules with worked-out results."""

from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lodgecast.functions.scoring import high_risk_count, round_half_even
from lodgecast.operators import rank as R
from lodgecast.operators.evaluate import METRICS, evaluate
from lodgecast.operators.monitor import batch_metrics, metrics_to_long, training_metrics
from lodgecast.plans.selection import text_at

P = R.PROBABILITY


def scored(spark, *pairs):
    return spark.createDataFrame(list(pairs), f"booking_id string, {P} double")


def test_three_bookings(spark):
    table = R.build_scoring_table(scored(spark, ("A", 0.2), ("B", 0.9), ("C", 0.5)), 0.34)
    found = [tuple(r) for r in table.orderBy("rank").collect()]
    assert found == [
        ("B", 0.9, 1, 33.33, 1, "top_30_percent"),
        ("C", 0.5, 2, 66.67, 1, "top_30_percent"),
        ("A", 0.2, 3, 100.0, 0, "regular"),
    ]
    assert tuple(R.batch_result_counts(table).first()) == (3, 2)
    assert [r["booking_id"] for r in R.top_risk_preview(table, 2).collect()] == ["B", "C"]
    assert R.standard_output(table).columns == ["booking_id", P, "rank"]


def test_ids_are_numbered_along_the_input(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.9), (2, 0.5)], f"input_position int, {P} double")
    numbered = R.assign_missing_ids(df)
    table = R.build_scoring_table(numbered, 0.2)
    assert table.count() == 3 and table.filter("rank = 1").first()["booking_id"] == 2
    named = scored(spark, ("A", 0.1))
    assert R.assign_missing_ids(named) is named


@pytest.mark.parametrize(
    "count, share, expected", [(10, 0.3, 3), (7, 0.3, 3), (1, 0.01, 1), (100, 0.07, 8), (9, 1.0, 9)]
)
def test_flagged_rows(spark, count, share, expected):
    df = spark.createDataFrame([(count,)], "n long")
    assert df.select(high_risk_count(F.col("n"), share)).first()[0] == expected


def test_threshold_uses_the_unrounded_probability(spark):
    found = R.flag_by_threshold(scored(spark, ("a", 0.85), ("b", 0.69996), ("c", 0.7)))
    assert {r["booking_id"]: (r[P], r["is_high_risk"], r["risk_segment"]) for r in found.collect()} == {
        "a": (0.85, 1, "high_risk"), "b": (0.7, 0, "regular"), "c": (0.7, 1, "high_risk"),
    }


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.12345,)], "v double")
    assert [r[0] for r in df.select(round_half_even(F.col("v"), 0)).collect()] == [0, 2, 2, 0]


def test_ties_rank_on_rounded_values_by_id(spark):
    df = scored(spark, ("b", 0.50004), ("a", 0.5), ("c", 0.50002), (None, 0.5))
    found = R.build_scoring_table(df, 1.0).orderBy("rank").collect()
    assert [r["booking_id"] for r in found] == [None, "a", "b", "c"]
    assert {r["is_high_risk"] for r in found} == {1}


def test_requests_are_ranked_apart(spark):
    df = spark.createDataFrame(
        [("r1", 0.5, "INN00001", 0.2), ("r1", 0.5, "INN00099", 0.9), ("r2", 0.1, "x", 0.1)],
        f"request_id string, risk_share double, booking_id string, {P} double",
    )
    found = {r["booking_id"]: r for r in R.score_requests(df).collect()}
    best = found["INN00099"]
    assert (best["rank"], best["risk_percentile"], best["is_high_risk"]) == (1, 50.0, 1)
    assert found["INN00001"]["is_high_risk"] == 0
    assert (found["x"]["rank"], found["x"]["is_high_risk"]) == (1, 1)


def test_json_records_keep_missing_ids(spark):
    table = R.build_scoring_table(scored(spark, (None, 0.25)))
    record = json.loads(R.scores_as_json(table).first()["record"])
    assert record == {
        "booking_id": None, P: 0.25, "is_high_risk": 1, "risk_segment": "top_30_percent",
    }


def test_batch_metrics(spark):
    scores = spark.createDataFrame(
        [(1, 0.91, 33.33), (0, 0.35, 66.67), (1, 0.72, 100.0)],
        f"is_high_risk int, {P} double, risk_percentile double",
    )
    summary = spark.createDataFrame(
        [(4, 3, 0, 1)], "records_before int, records_after int, duplicates_count int, invalid_dates_count int"
    )
    found = {r["metric_name"]: r["metric_value"] for r in batch_metrics(summary, scores).collect()}
    assert found == pytest.approx(
        {
            "records_before_preprocessing": 4, "records_after_preprocessing": 3,
            "predictions_count": 3, "high_risk_count": 2, "high_risk_share": 2 / 3,
            "mean_cancellation_probability": 0.66, "max_cancellation_probability": 0.91,
            "min_cancellation_probability": 0.35, "avg_risk_percentile": 200 / 3,
            "invalid_dates_count": 1,
        }
    )


def test_training_metrics(spark):
    summary = spark.createDataFrame(
        [(120, 100, 5, 2)], "records_before int, records_after int, duplicates_count int, invalid_dates_count int"
    )
    evaluation = spark.createDataFrame(
        [(0.9, 0.8, 0.7, 0.75, 0.87)], ", ".join(f"{m} double" for m in METRICS)
    )
    found = {r["metric_name"]: r["metric_value"] for r in training_metrics(summary, evaluation).collect()}
    assert found["records_before_preprocessing"] == 120 and found["records_after_preprocessing"] == 100
    assert found["duplicates_count"] == 5 and found["invalid_dates_count"] == 2
    assert found["eval_accuracy"] == 0.9 and found["eval_roc_auc"] == 0.87 and len(found) == 9


def test_long_metrics_are_double(spark):
    long = metrics_to_long(spark.createDataFrame([(1, 2.5)], "a int, b double"))
    assert rows(long, "metric_name", "metric_value") == [("a", 1.0), ("b", 2.5)]


def predictions(spark, *data):
    return spark.createDataFrame(list(data), "label int, prediction int, probability double")


def test_a_perfect_classifier(spark):
    df = predictions(spark, (1, 1, 0.9), (0, 0, 0.2), (1, 1, 0.8), (0, 0, 0.3))
    assert tuple(evaluate(df).first()) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_nothing_predicted_gives_zeros_and_ties_give_half(spark):
    df = predictions(spark, (1, 0, 0.4), (0, 0, 0.4), (1, 0, 0.4), (0, 0, 0.4))
    assert tuple(evaluate(df).first()) == (0.5, 0.0, 0.0, 0.0, 0.5)


def test_one_class_has_no_area(spark):
    assert evaluate(predictions(spark, (1, 1, 0.4))).first()["roc_auc"] is None


def test_area_equals_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from lodgecast.operators.evaluate import roc_auc

    df = spark.range(0, 4000).select(
        (F.rand(1) < 0.4).cast("int").alias("label"),
        (F.floor(F.rand(2) * 200) / 200).alias("probability"),
    ).withColumn("prediction", F.lit(0))
    df = spark.createDataFrame(df.collect(), df.schema)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="probability", labelCol="label", numBins=0
    )
    assert roc_auc(df).first()[0] == pytest.approx(evaluator.evaluate(df), abs=1e-9)


@pytest.mark.parametrize("share", [0.01, 0.3, 0.5, 1.0])
def test_flags_without_ranking_are_those_of_the_ranking(spark, share):
    """Many ties, missing ids, and ids that only differ late."""
    cells = [(None if i % 37 == 0 else f"INN{i * 7919 % 1000:05d}", (i % 7) / 10) for i in range(700)]
    df = spark.createDataFrame(cells, f"booking_id string, {R.PROBABILITY} double")
    columns = ["booking_id", R.PROBABILITY, "is_high_risk", "risk_segment"]
    ranked = R.build_scoring_table(df, share)
    assert rows(R.flag_riskiest(df, share), *columns) == rows(ranked, *columns)
    assert rows(R.high_risk_table(df, share), "rank", *columns[1:3]) == rows(
        R.filter_high_risk(ranked), "rank", *columns[1:3]
    )
    totals = R.batch_result_counts(ranked).first()
    assert R.result_totals(df, share).first() == totals
    assert rows(R.riskiest(df, 5, share), "rank", "risk_percentile") == rows(
        R.top_risk_preview(ranked, 5), "rank", "risk_percentile"
    )


def test_flags_of_equal_ids_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0.5)] * 4, f"booking_id string, {R.PROBABILITY} double")
    assert R.flag_riskiest(df, 0.5).filter("is_high_risk = 1").count() == 2
    assert R.flag_riskiest(df.limit(0), 0.5).count() == 0
    assert R.result_totals(df.limit(0)).first() == (0, 0)


def test_text_at_every_place(spark):
    texts = [None, "", "a", "a", "ab", "abc", "abcd", "b", "é", "zz", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ordered = sorted(texts, key=lambda t: (t is not None, t or ""))
    assert [text_at(df, "t", i, limit=1) for i in range(len(texts))] == ordered
