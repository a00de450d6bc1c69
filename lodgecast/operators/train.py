"""Boosted-tree and baseline classifiers on cleaned bookings, with Spark ML."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lodgecast.functions.scoring import row_key, uniform_hash
from lodgecast.operators.clean import Cleaned, preprocess_bookings
from lodgecast.operators.encode import LabelRates, fit_label_rates, number_categories
from lodgecast.operators.evaluate import METRICS, evaluate, roc_auc
from lodgecast.operators.rank import (
    PROBABILITY,
    assign_missing_ids,
    build_scoring_table,
    flag_by_threshold,
)
from lodgecast.operators.split import split_stratified
from lodgecast.plans.storage import small_frame, stored
from lodgecast.schemas import (
    DATE,
    HIGH_RISK_THRESHOLD,
    ID,
    LABEL,
    POSITION,
    RISK_SHARE,
    SEED,
    TEST_SIZE,
)
from lodgecast.session import checkpoint_folder, scratch_path

MODEL_NAME = "GBT"
VALIDATION_SHARE = 0.1  # of the training rows; boosting ends when their error no longer falls
FIRST_ROUNDS = 25
PARTITION_ROWS = 20_000  # of assembled vectors, so that small fits are not many tiny tasks
_VALIDATION = "_validation"
_TURNS = "rounds int, best int, error double"
_SEARCH = "settings string, fold int, roc_auc double, trees int"

# Training settings, in the terms of Spark's boosted trees. Leaf count, L1 and L2
# penalties have no counterpart there.
FULL_PARAMS = {
    "maxIter": 700,
    "stepSize": 0.03,
    "maxDepth": 8,
    "minInstancesPerNode": 30,
    "subsamplingRate": 0.85,
    "featureSubsetStrategy": "0.85",
    "minInfoGain": 0.0,
    "lossType": "logistic",
}


def categorical_columns(df: DataFrame) -> list[str]:
    """String feature columns."""
    skipped = (ID, LABEL, DATE, "split")
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skipped
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    skipped = (ID, LABEL)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skipped
    ]


@dataclass
class BookingModel:
    """A fitted classifier with the label rates its categorical features come from."""

    rates: LabelRates
    pipeline: PipelineModel

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.rates.transform(df))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.rates.save(f"{path}/rates")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BookingModel:
        return cls(LabelRates.load(spark, f"{path}/rates"), PipelineModel.load(f"{path}/pipeline"))


def encode_categories(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``<column>_index`` to both frames: the values of ``train`` in alphabetical order from 0,
    others the next number. Columns may have any number of values."""
    numbers = number_categories(train, categorical_columns(train))
    return numbers.transform(train), numbers.transform(test)


@dataclass
class Assembled:
    """Feature vectors of training rows, written once for every fit that reads them."""

    rates: LabelRates
    assembler: VectorAssembler
    frame: DataFrame

    def fit(self, classifier, held_out: bool = False) -> BookingModel:
        """``held_out`` leaves the validation rows out."""
        checkpoint_folder(self.frame.sparkSession)
        fitted = _fitted(classifier, self.frame.filter(~F.col(_VALIDATION)) if held_out else self.frame)
        return BookingModel(self.rates, PipelineModel([self.assembler, fitted]))


def _fitted(classifier, vectors: DataFrame):
    """The fitted classifier without its training summary.

    The summary holds the session, and a session that has observed a query cannot be sent to
    tasks, so a model with a summary could score nothing there. A model that was written and
    read again has none.
    """
    fitted = classifier.fit(vectors)
    if not getattr(fitted, "hasSummary", False):
        return fitted
    path = scratch_path(vectors.sparkSession, "classifier")
    fitted.write().save(path)
    return type(fitted).load(path)


def assemble(train: DataFrame, seed: int = SEED, validation: float = VALIDATION_SHARE) -> Assembled:
    """Numbers as they are, categories as label rates of other folds, and which rows to stop by.

    ``train`` is read a few times: pass a stored frame.
    """
    rates, coded = fit_label_rates(train, categorical_columns(train), seed=seed)
    assembler = VectorAssembler(
        inputCols=numeric_columns(train) + rates.outputs, outputCol="features", handleInvalid="keep"
    )
    held = uniform_hash(row_key(coded), f"{seed}-validation") < F.lit(int(validation * 2**52))
    vectors = assembler.transform(coded.withColumn(_VALIDATION, held))
    frame = stored(vectors.select(LABEL, "features", _VALIDATION), "vectors")
    parts = max(1, -(-rates.rows // PARTITION_ROWS))
    return Assembled(rates, assembler, frame.coalesce(parts))


def boosted_trees(params: dict | None = None, seed: int = SEED) -> GBTClassifier:
    """``params`` defaults to :data:`FULL_PARAMS`. Every ten rounds the state is written to the
    checkpoint folder, so that a lost executor does not cost all rounds before."""
    settings = {"checkpointInterval": 10, **(FULL_PARAMS if params is None else params)}
    return GBTClassifier(labelCol=LABEL, seed=seed, **settings)


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model that a fit of ``count`` rounds gives, taken from a fit of more rounds.

    Spark draws each round's rows and features by the seed and the round's number, so the first
    trees do not depend on how many follow.
    """
    context = SparkSession.active().sparkContext
    jvm, fitted = context._jvm, model._to_java()
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = context._gateway.new_array(jvm.double, count)
    for i, (tree, weight) in enumerate(zip(fitted.trees()[:count], fitted.treeWeights()[:count])):
        trees[i], weights[i] = tree, weight
    kind = jvm.org.apache.spark.ml.classification.GBTClassificationModel
    cut = GBTClassificationModel(kind(fitted.uid(), trees, weights, model.numFeatures, model.numClasses))
    return model._copyValues(cut, {cut.maxIter: count})


def fit_until_settled(
    vectors: Assembled, params: dict | None = None, seed: int = SEED, progress: str | None = None
) -> BookingModel:
    """Boosted trees, as many as the held validation rows want, ``maxIter`` at most.

    The rounds are doubled from :data:`FIRST_ROUNDS` on until the smallest validation error lies in
    their first half, so the last half of the rounds has brought nothing. The model then has the
    trees up to that smallest error, taken from the last turn (:func:`first_trees`). Each turn is
    appended to the folder ``progress``, and a fit that was stopped goes on after the last turn
    found there. Without validation rows all rounds are made.
    """
    spark = vectors.frame.sparkSession
    params = FULL_PARAMS if params is None else params
    most = params.get("maxIter", 20)
    progress = progress or scratch_path(spark, "boosting")
    held = vectors.frame.filter(_VALIDATION)
    turns = {r["rounds"]: r["best"] for r in _finished(spark, progress, _TURNS)}
    rounds, model = min(FIRST_ROUNDS, most), None
    if held.isEmpty():
        return vectors.fit(boosted_trees(params, seed))
    while True:
        if rounds not in turns:
            model = vectors.fit(boosted_trees({**params, "maxIter": rounds}, seed), held_out=True)
            errors = model.classifier.evaluateEachIteration(held)
            turns[rounds] = 1 + min(range(len(errors)), key=errors.__getitem__)
            turn = small_frame(spark, [(rounds, turns[rounds], min(errors))], _TURNS)
            turn.write.mode("append").parquet(progress)
        if 2 * turns[rounds] <= rounds or rounds == most:
            break
        rounds, model = min(2 * rounds, most), None
    if model is not None:
        kept = model.classifier
        if kept.getNumTrees > turns[rounds]:
            kept = first_trees(kept, turns[rounds])
        return BookingModel(model.rates, PipelineModel([vectors.assembler, kept]))
    return vectors.fit(boosted_trees({**params, "maxIter": turns[rounds]}, seed), held_out=True)


def train_model(
    train: DataFrame, params: dict | None = None, seed: int = SEED, progress: str | None = None
) -> BookingModel:
    """Boosted trees on every feature column; ``params`` defaults to :data:`FULL_PARAMS`. See
    :func:`fit_until_settled` for when it ends."""
    return fit_until_settled(assemble(train, seed), params, seed, progress)


def train_baseline_lr(train: DataFrame) -> PipelineModel:
    """Logistic regression on price, length of stay and lead time."""
    features = VectorAssembler(
        inputCols=["average_price", "total_nights", "lead_time"],
        outputCol="features",
        handleInvalid="keep",
    )
    vectors = stored(features.transform(train).select(LABEL, "features"), "vectors")
    return PipelineModel([features, _fitted(LogisticRegression(labelCol=LABEL, maxIter=50), vectors)])


def predict_proba(model: BookingModel | PipelineModel, df: DataFrame) -> DataFrame:
    """Add the probability of class 1 and the predicted class; vectors are dropped."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        vector_to_array("probability")[1].alias(PROBABILITY),
        F.col("prediction").cast("int").alias("prediction"),
    )


def evaluate_model(model: BookingModel | PipelineModel, test: DataFrame) -> DataFrame:
    """:func:`evaluate` of a fitted model on labelled rows."""
    predictions = stored(
        predict_proba(model, test).select(LABEL, "prediction", PROBABILITY), "predictions"
    )
    return evaluate(predictions, LABEL, "prediction", PROBABILITY)


def compare_models(
    train: DataFrame,
    test: DataFrame,
    classifiers: dict | None = None,
    seed: int = SEED,
    params: dict | None = None,
) -> tuple[DataFrame, dict[str, BookingModel]]:
    """Fit candidates and measure each on ``test``; (metric rows with ``is_best``, models).

    A candidate that is None stands for boosted trees with ``params``, as many as they need.
    """
    classifiers = classifiers or {
        "LogisticRegression": LogisticRegression(labelCol=LABEL, maxIter=50),
        "RandomForest": RandomForestClassifier(labelCol=LABEL, seed=seed),
        "GBT": None,
    }
    vectors = assemble(train, seed)
    models = {
        name: vectors.fit(classifier) if classifier is not None else fit_until_settled(vectors, params, seed)
        for name, classifier in classifiers.items()
    }
    rows = []
    for name, model in models.items():
        metrics = evaluate_model(model, test).first().asDict()
        rows.append((name, *[metrics[m] for m in METRICS]))
    best = max(rows, key=lambda r: (r[-1] or 0.0, r[0]))[0]
    schema = "model string, " + ", ".join(f"{m} double" for m in METRICS) + ", is_best boolean"
    return small_frame(train.sparkSession, [(*r, r[0] == best) for r in rows], schema), models


def cross_validate(
    train: DataFrame,
    grid: dict[str, list],
    folds: int = 3,
    seed: int = SEED,
    base: dict | None = None,
    progress: str | None = None,
) -> tuple[DataFrame, BookingModel]:
    """K-fold search over boosted-tree settings by ROC-AUC; (mean score and trees per setting, the
    best setting's model of all rows).

    Folds come from the booking id, so a rerun uses the same ones. Label rates are taken from a
    fold's training rows only. Each fit's score is appended to the folder ``progress``; a search
    that was stopped and is started again with the same folder, rows and seed goes on after the
    last of them. Without it the scores are kept among the intermediates.
    """
    spark = train.sparkSession
    progress = progress or scratch_path(spark, "cross-validation")
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    fold = F.pmod(uniform_hash(row_key(train), seed), F.lit(folds)).cast("int")
    folded = stored(train.withColumn("_cv_fold", fold), "cross-validation")
    names = [json.dumps(s, sort_keys=True) for s in settings]
    done = {(r["settings"], r["fold"]): r for r in _finished(spark, progress, _SEARCH)}
    for k in range(folds):
        wanted = [(name, s) for name, s in zip(names, settings) if (name, k) not in done]
        if not wanted:
            continue
        vectors = assemble(folded.filter(F.col("_cv_fold") != k).drop("_cv_fold"), seed)
        held = folded.filter(F.col("_cv_fold") == k).drop("_cv_fold")
        for name, setting in wanted:
            model = fit_until_settled(vectors, {**(base or FULL_PARAMS), **setting}, seed)
            scores = stored(predict_proba(model, held).select(LABEL, PROBABILITY), "held-out-scores")
            area = roc_auc(scores, LABEL, PROBABILITY).first()["roc_auc"]
            row = small_frame(spark, [(name, k, area, model.classifier.getNumTrees)], _SEARCH)
            row.write.mode("append").parquet(progress)
    found = spark.read.schema(_SEARCH).parquet(progress)
    means = {
        r["settings"]: r
        for r in found.filter(F.col("settings").isin(names) & (F.col("fold") < folds))
        .dropDuplicates(["settings", "fold"])
        .groupBy("settings")
        .agg(F.avg("roc_auc").alias("score"), F.avg("trees").alias("trees"))
        .collect()
    }
    best = max(names, key=lambda n: (means[n]["score"] or 0.0, n))
    rows = [(n, means[n]["score"], means[n]["trees"], n == best) for n in names]
    schema = "settings string, mean_roc_auc double, mean_trees double, is_best boolean"
    chosen = train_model(train, {**(base or FULL_PARAMS), **json.loads(best)}, seed)
    return small_frame(spark, rows, schema), chosen


def _finished(spark: SparkSession, path: str, schema: str) -> list:
    """Rows of a progress folder; one row per finished fit."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException:  # nothing finished yet
        return []


@dataclass
class TrainingRun:
    """A fitted model, its metrics (one row) and its report."""

    model: BookingModel
    metrics: DataFrame
    summary: DataFrame
    report: dict
    version: str


def training_report(
    summary: dict,
    split_rows: dict[str, int],
    metrics: dict,
    categories: list[str],
    params: dict,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    model_name: str = MODEL_NAME,
) -> dict:
    """Report of a training run; written as JSON next to the model."""
    # Report layout.
    return {
        "split": {
            "test_size": test_size,
            "random_state": seed,
            "train_rows": split_rows.get("train", 0),
            "test_rows": split_rows.get("test", 0),
        },
        "preprocessing": {
            "original_shape": [summary["records_before"], summary["columns_before"]],
            "processed_shape": [summary["records_after"], summary["columns_after"]],
            "duplicates_count": summary["duplicates_count"],
            "invalid_dates_count": summary["invalid_dates_count"],
            "added_features": summary["added_features"],
            "removed_features": summary["removed_features"],
        },
        "categorical_columns": categories,
        "parameters": {model_name: params},
        "metrics": {model_name: metrics},
        "best_model": {"name": model_name, "reason": "only model trained in this run"},
    }


def train_and_report(
    raw: DataFrame,
    params: dict | None = None,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    stats: DataFrame | None = None,
) -> TrainingRun:
    """Clean, split, fit, evaluate and report.

    The cleaned frame is written once: split, fit and report all read it. ``raw`` should be a
    file scan or a stored frame.
    """
    params = FULL_PARAMS if params is None else params
    cleaned = preprocess_bookings(raw, is_training=True, stats=stats, store_groups=True)
    frame = stored(cleaned.frame.drop(POSITION), "cleaned")
    parts = stored(split_stratified(frame, test_size, seed), "split")
    train = parts.filter(F.col("split") == "train").drop("split")
    test = parts.filter(F.col("split") == "test").drop("split")
    model = train_model(train, params, seed)
    row = evaluate_model(model, test).first()
    schema = ", ".join(f"{m} double" for m in METRICS)
    metrics = small_frame(raw.sparkSession, [tuple(row)], schema)
    sizes = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    summary = stored(cleaned.summary, "summary")
    report = training_report(
        summary.first().asDict(), sizes, row.asDict(), categorical_columns(train), params, test_size, seed
    )
    version = f"{MODEL_NAME.lower()}_{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}"
    return TrainingRun(model, metrics, summary, report, version)


@dataclass
class ScoringRun:
    """Scores of a batch, its cleaning result and the score table."""

    scores: DataFrame
    cleaned: Cleaned


def score_batch(
    raw: DataFrame, model: BookingModel, share: float = RISK_SHARE, stats: DataFrame | None = None
) -> ScoringRun:
    """Clean new bookings, score them and build the ranked table.

    Without an id column the rows that stay are numbered along their input position.
    """
    cleaned = preprocess_bookings(raw, is_training=False, stats=stats)
    scored = predict_proba(model, cleaned.frame)
    if ID in scored.columns:
        return ScoringRun(build_scoring_table(scored, share), cleaned)
    numbered = assign_missing_ids(scored.select(POSITION, PROBABILITY))
    return ScoringRun(build_scoring_table(numbered, share), cleaned)


def score_single_rule(
    raw: DataFrame,
    model: BookingModel,
    stats: DataFrame | None = None,
    threshold: float = HIGH_RISK_THRESHOLD,
) -> DataFrame:
    """Judge every booking alone by the threshold, without a ranking."""
    cleaned = preprocess_bookings(raw, is_training=False, stats=stats)
    scored = predict_proba(model, cleaned.frame).select(ID, PROBABILITY)
    return flag_by_threshold(scored, threshold)
